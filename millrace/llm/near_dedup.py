"""Near-duplicate groups by HyperMinHash sketches, every link confirmed on full sets.

A document's set is the distinct runs of ``size`` words.  Its hashes fall into registers by
their high part; a register keeps, of the smallest remainder, the number of leading zeros and a
few mantissa bits.  Empty registers borrow from others before registers are banded, so that
short documents band as long ones do.  Documents with one set are one node, named by the first.

Nodes that share a band are candidates.  Each is compared with the first node of each of its
bands: the Jaccard estimate of the two sketches, corrected for collisions, drops pairs that are
far off, and the others are decided on the full sets.  The links join nodes to components.
A link between nodes that are no link of their band's first node must not be lost.  So within
a cluster, which is what near pairs hold together, sets of different components are compared as
matrix products of bounded blocks, but for those that an exact prefix filter shows to be linked with
none; and where a band holds nodes of several clusters, their
sketches are compared across clusters, and what is near is decided on the full sets.  Nodes
already joined are not paired at all.

With 50 bands of 6 registers, a pair at similarity 0.8 shares no band with probability 2.5e-7, and
one above it with less.  Below 0.8 the bands would lose links, so a smaller percent is refused.

Defined cases: a null or empty text, or one without a word, has an empty set and is linked with
nothing; one word is a set of one; copies share a node; rows that repeat a ``doc_id`` are rows of
their own, and a null one comes last; an empty table gives an empty result; other columns
pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.rows import arrow_schema, bytes_of, chunks, numbered
from millrace.llm.spans import STEP, Words, fold_table, mixed
from millrace.operators.probe import bitmaps_of, possible, without
from millrace.scratch import fresh_dir

BANDS = 50
ROWS = 6
REGISTERS = BANDS * ROWS
LEAST_PERCENT = 80  # what the bands are made for
MANTISSA = 10
PROBES = 16
MARGIN = 5.5
BLOCK_ROWS = 256
COLUMNS = 16_384
SMALL_ROWS = 500_000

WORD_TABLE = fold_table(lambda b: b != 32 and not 9 <= b <= 13)
EMPTY = np.uint16(0)

SKETCHED = "doc bigint, doc_id bigint, n_shingles bigint, dg1 bigint, dg2 bigint, registers binary"
BANDED = "key bigint, node bigint"
SETS = "node bigint, grams binary"
PAIR = "a bigint, b bigint"


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``size`` are one."""
    words = Words(texts, WORD_TABLE)
    h, out = words.hashes, []
    n = len(h) - size + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for j in range(size if n > 0 else 0):
        grams = grams * np.uint64(STEP) + h[j : j + n]
    grams = mixed(grams)
    for first, count in zip(words.first.tolist(), words.counts.tolist()):
        if count >= size:
            own = np.sort(grams[first : first + count - size + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif count:
            key = b" ".join([count.to_bytes(2, "little"), words.joined(first, count)])
            short = blake2b(key, digest_size=8).digest()
            out.append(np.frombuffer(short, np.uint64).copy())
        else:
            out.append(np.empty(0, np.uint64))
    return out


def digest_of(grams: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    return blake2b(grams.tobytes(), digest_size=16).digest()


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``REGISTERS`` 16-bit registers for each set, 0 for an empty register.

    The remainder's leading zeros take the high bits and the mantissa the low ones, arranged so
    that smaller remainders give larger values and no value is 0.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    h = np.concatenate([np.empty(0, np.uint64), *sets])
    place = ((h >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    place = place.astype(np.int64) + np.repeat(np.arange(len(sets)) * REGISTERS, sizes)
    rest = mixed(h ^ np.uint64(STEP)) >> np.uint64(12)  # 52 bits, exact as a float
    least = np.full(len(sets) * REGISTERS, np.uint64(2**63))
    np.minimum.at(least, place, rest)
    found = least < 2**63
    value = np.maximum(least[found], 1).astype(np.float64)
    part, exponent = np.frexp(value)
    zeros = np.minimum(52 - exponent, 62)
    mantissa = ((part - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64)
    out = np.zeros(len(sets) * REGISTERS, np.uint16)
    out[found] = ((zeros + 1) << MANTISSA | mantissa).astype(np.uint16)
    return out.reshape(len(sets), REGISTERS)


def _probe_order() -> np.ndarray:
    tries = np.arange(PROBES * REGISTERS, dtype=np.uint64).reshape(PROBES, REGISTERS)
    return (mixed(tries + np.uint64(STEP)) % np.uint64(REGISTERS)).astype(np.int64)


PROBE_ORDER = _probe_order()


def filled(registers: np.ndarray) -> np.ndarray:
    """Registers with empty ones filled from others, in an order all documents share."""
    out = registers.copy()
    for order in PROBE_ORDER:
        gaps = out == EMPTY
        if not gaps.any():
            return out
        out = np.where(gaps, registers[:, order], out)
    for turn in range(1, REGISTERS):
        gaps = out == EMPTY
        if not gaps.any():
            break
        out = np.where(gaps, np.roll(registers, turn, axis=1), out)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each row."""
    values = filled(registers).astype(np.uint64).reshape(len(registers), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), values.shape[:2]).copy()
    for j in range(ROWS):
        key = mixed(key * np.uint64(STEP) + values[:, :, j])
    return key


def likely(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sketches, row by row, may belong to sets at ``threshold``.

    Two different sets agree in a register by chance in about one of ``2**MANTISSA`` cases,
    scaled by how remainders spread; that share is taken out of the estimate.  The margin is
    ``MARGIN`` standard deviations of the estimate at the threshold.
    """
    used = ((a != EMPTY) | (b != EMPTY)).sum(-1)
    same = ((a == b) & (a != EMPTY)).sum(-1)
    used = np.maximum(used, 1)
    chance = 0.7 / (1 << MANTISSA)
    estimate = (same / used - chance) / (1 - chance)
    return estimate >= threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / used)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * common >= percent * united, on full sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """``SKETCHED`` for ``doc``, ``doc_id``, ``text``; an empty set has no digest and no registers."""
    kind = arrow_schema(SKETCHED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(bytes_of(part.column(2)), size)
                n = np.array([len(s) for s in sets], np.int64)
                digests = np.frombuffer(b"".join([digest_of(s) for s in sets]), np.int64).reshape(-1, 2)
                registers = [r.tobytes() if m else None for r, m in zip(registers_of(sets), n.tolist())]
                columns = [
                    part.column(0),
                    part.column(1),
                    pa.array(n),
                    pa.array(digests[:, 0], mask=n == 0),
                    pa.array(digests[:, 1], mask=n == 0),
                    pa.array(registers, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=kind)

    return docs.mapInArrow(run, SKETCHED)


def _banded(nodes: DataFrame) -> DataFrame:
    """``BANDED``: each band of each node (``node``, ``registers``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = band_keys(_registers(part.column(1).to_pylist()))
                nodes_of = np.repeat(part.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(nodes_of)], ["key", "node"]
                )

    return nodes.select("node", "registers").mapInArrow(run, BANDED)


def _registers(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint16).reshape(-1, REGISTERS)


def _small(df: DataFrame, small_rows: int) -> DataFrame:
    """``df``, a written table of narrow rows, for a broadcast if it is small, else as it is."""
    return F.broadcast(df) if df.count() <= small_rows else df


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``SETS`` of the wanted nodes (``node``, stored) and perhaps of a few more; texts stay where they are."""
    kind = arrow_schema(SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(bytes_of(part.column(1)), size)
                grams = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), grams], schema=kind)

    texts = docs.select(F.col("doc").alias("node"), "text")
    return possible(texts, bitmaps_of(wanted, "node"), "node").mapInArrow(run, SETS)


def _near(pairs: DataFrame, registers: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and sketches (``node``, ``n``, ``registers``) allow a link."""
    one = registers.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("registers").alias("va"))
    two = registers.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("vb"))
    sized = pairs.join(one, "a").join(two, "b").filter(
        100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    )
    return _filter(
        sized.select("a", "b", "va", "vb"),
        lambda a, b: likely(_registers(a), _registers(b), percent / 100),
    )


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links, on full sets."""
    one = sets.select(F.col("node").alias("a"), F.col("grams").alias("va"))
    two = sets.select(F.col("node").alias("b"), F.col("grams").alias("vb"))
    return _filter(
        pairs.join(one, "a").join(two, "b").select("a", "b", "va", "vb"),
        lambda a, b: [
            linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b)
        ],
    )


def _filter(rows: DataFrame, keep: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                if part.num_rows:
                    kept = keep(part.column(2).to_pylist(), part.column(3).to_pylist())
                    yield part.select([0, 1]).filter(pa.array(np.asarray(kept, bool)))

    return rows.mapInArrow(run, PAIR)


def _dealt(members: DataFrame, block_rows: int, columns: list[str], path: str) -> DataFrame:
    """Pairs of blocks, ``key``, ``x``, ``y``, of members of one key and different components.

    ``members``: ``key``, ``node``, ``component`` and ``columns``.  The component with most nodes of
    a key is one side (``side`` 0), the key's other nodes the other side and, among themselves,
    both.  Blocks are dealt by hash, of ``block_rows`` nodes on average, so no task holds a key.
    """
    per = members.groupBy("key", "component").agg(F.count("*").alias("c"))
    per = per.groupBy("key").agg(
        F.max(F.struct("c", "component")).alias("main"), F.sum("c").alias("c"), F.count("*").alias("k")
    )
    blocks = lambda rows: F.greatest(F.ceil(rows / F.lit(block_rows)), F.lit(1)).cast("int")
    per = per.filter("k > 1").select(
        "key",
        F.col("main.component").alias("main"),
        blocks(F.col("main.c")).alias("n_main"),
        blocks(F.col("c") - F.col("main.c")).alias("n_rest"),
    )
    # Written first: an aggregate below the join would keep a key's members in one task.
    per.write.parquet(path)
    told = members.join(members.sparkSession.read.schema(per.schema).parquet(path), "key")
    is_main = F.col("component") == F.col("main")
    deal = lambda n: F.pmod(F.xxhash64("node", "key"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    columns = ["key", "node", "component", *columns]
    main = told.filter(is_main).select(
        *columns, F.lit(0).alias("side"), deal("n_main").alias("x"), F.explode(upto("n_rest")).alias("y")
    )
    rest = told.filter(~is_main).withColumn("own", deal("n_rest"))
    against = rest.select(
        *columns, F.lit(1).alias("side"), F.explode(upto("n_main")).alias("x"), F.col("own").alias("y")
    )
    # Blocks of the rest among themselves: x counts on after those of the main side.
    left = rest.select(
        *columns, F.lit(0).alias("side"), (F.col("n_main") + F.col("own")).alias("x"),
        F.explode(F.sequence(F.col("own"), F.col("n_rest") - 1)).alias("y"),
    )
    lower = F.transform(F.sequence(F.lit(0), F.col("own")), lambda i: F.col("n_main") + i)
    right = rest.select(*columns, F.lit(1).alias("side"), F.explode(lower).alias("x"), F.col("own").alias("y"))
    return main.unionByName(against).unionByName(left).unionByName(right)


def _across(members: DataFrame, block_rows: int, percent: int, path: str) -> DataFrame:
    """Pairs of one band and different clusters (``component``) whose sketches allow a link."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        one, two = (frame[frame["side"] == side] for side in (0, 1))
        found = []
        if len(one) and len(two):
            registers = _registers(one["registers"].tolist())
            own, n, nodes = (one[c].to_numpy() for c in ("component", "n", "node"))
            for node, component, m, value in zip(two["node"], two["component"], two["n"], two["registers"]):
                sized = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
                at = np.flatnonzero((own != component) & sized)
                at = at[likely(registers[at], _registers([value]), percent / 100)]
                found.append(np.stack([np.minimum(nodes[at], node), np.maximum(nodes[at], node)], 1))
        pairs = np.concatenate([np.empty((0, 2), np.int64), *found])
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    dealt = _dealt(members, block_rows, ["n", "registers"], path)
    dealt = dealt.repartition(_tasks(members), "key", "x", "y")
    return dealt.groupBy("key", "x", "y").applyInPandas(run, PAIR).distinct()


def _tasks(df: DataFrame) -> int:
    """A stated number of tasks, for rows that are few bytes and much work."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


GRAMS = "key bigint, node bigint, n bigint, gram bigint"


def _grams(members: DataFrame) -> DataFrame:
    """``GRAMS``: the values of the sets of ``members`` (``key``, ``node``, ``grams``), a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1 << 20):
                sets = [np.frombuffer(g, np.int64) for g in part.column(2).to_pylist()]
                sizes = np.array([len(values) for values in sets], np.int64)
                rows = np.repeat(np.arange(len(sets)), sizes)
                columns = part.column(0).to_numpy()[rows], part.column(1).to_numpy()[rows], sizes[rows]
                values = np.concatenate([np.empty(0, np.int64), *sets])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, values)], ["key", "node", "n", "gram"])

    return members.select("key", "node", "grams").mapInArrow(run, GRAMS)


def _prefixes(members: DataFrame, percent: int, path: str) -> DataFrame:
    """``node`` of the sets that may be linked with another of their cluster, perhaps repeated.

    The values of a set are ordered by how many sets of the cluster hold them, rarest first.  Of two
    sets that are linked, the first common value is among the first ``n - needed + 1`` of each, where
    ``needed`` is the least number of values that a set of ``n`` shares with a linked one.  Values that
    no other set holds come first; a set that has so many of them is linked with none.
    """
    spark = members.sparkSession
    token = F.xxhash64("key", "gram").alias("key")
    held = _grams(members).select(token, "node", "n")
    counts = held.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    counts.write.parquet(f"{path}-counts")
    counts = spark.read.schema(counts.schema).parquet(f"{path}-counts")
    shared = held.join(counts, "key").groupBy("node", "n").agg(F.count("*").alias("shared"))
    needed = F.floor((F.col("n") * percent + 99) / 100)
    return shared.filter(F.col("n") - F.col("shared") < F.col("n") - needed + 1).select("node")


def common_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many values each set of one list shares with each of the other.

    A matrix product over the values that both lists hold, so many columns at a time.
    """
    out = np.zeros((len(one), len(two)), np.float32)
    both = np.intersect1d(np.concatenate(one), np.concatenate(two))
    for at in range(0, len(both), COLUMNS):
        some = both[at : at + COLUMNS]

        def marks(sets: list[np.ndarray]) -> np.ndarray:
            matrix = np.zeros((len(sets), len(some)), np.float32)
            for i, values in enumerate(sets):
                place = np.minimum(np.searchsorted(some, values), len(some) - 1)
                matrix[i, place[some[place] == values]] = 1
            return matrix

        out += marks(one) @ marks(two).T
    return out.astype(np.int64)


def _within(clustered: DataFrame, sets: DataFrame, block_rows: int, percent: int, path: str) -> DataFrame:
    """Links between components of one cluster (``key``), on full sets (``grams``).

    An exact prefix filter leaves out the nodes that are no link of any other; the others are compared
    as matrix products of bounded blocks.  Of the links between two components a task tells one.
    """
    spark = clustered.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{path}-{name}")
        return spark.read.schema(df.schema).parquet(f"{path}-{name}")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        one, two = (frame[frame["side"] == side] for side in (0, 1))
        found = {}
        if len(one) and len(two):
            sets = [[np.frombuffer(g, np.uint64) for g in side["grams"]] for side in (one, two)]
            common = common_counts(*sets)
            n, m = (np.array([len(s) for s in side]) for side in sets)
            fits = 100 * common >= percent * (n[:, None] + m[None, :] - common)
            own, other = one["component"].to_numpy(), two["component"].to_numpy()
            fits &= own[:, None] != other[None, :]
            for i, j in np.argwhere(fits).tolist():
                found.setdefault((own[i], other[j]), (one["node"].iat[i], two["node"].iat[j]))
        return pd.DataFrame(list(found.values()), columns=["a", "b"], dtype="int64")

    ends = clustered.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    undecided = stored(ends.filter("low <> high").select("key"), "undecided")
    members = stored(clustered.join(undecided, "key").join(sets, "node"), "members")
    alive = stored(_prefixes(members, percent, path).select("node").distinct(), "alive")
    members = members.join(alive, "node", "left_semi").select("key", "node", "component", "grams")
    dealt = _dealt(stored(members, "alike"), block_rows, ["grams"], f"{path}-per")
    dealt = dealt.repartition(_tasks(clustered), "key", "x", "y")
    return dealt.groupBy("key", "x", "y").applyInPandas(run, PAIR)


def _grouped(docs: DataFrame, work: str, size: int, percent: int, block_rows: int, small_rows: int) -> DataFrame:
    """``doc``, ``doc_id``, ``n_shingles``, ``first``: the smallest ``doc`` that links lead to.

    ``docs``: ``doc`` (a number of its own for each row), ``doc_id``, ``text``.
    """
    spark = docs.sparkSession
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"the bands find pairs at {LEAST_PERCENT} to 100 percent, not at {percent}")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    sketched = stored(sketch(docs, size), "sketched")
    named = sketched.filter("dg1 IS NOT NULL")
    firsts = named.groupBy("dg1", "dg2").agg(F.min("doc").alias("node"), F.count("*").alias("c"))
    # A digest that most rows have is on the side of the join that can be split.
    repeated = stored(firsts.filter("c > 1").select("dg1", "dg2", "node"), "repeated")
    same = named.select("doc", "dg1", "dg2").join(_small(repeated, small_rows), ["dg1", "dg2"])
    copies = stored(same.filter("doc <> node").select("doc", "node"), "copies")
    others = named.join(_small(copies.select("doc"), small_rows), "doc", "left_anti")
    nodes = others.select(F.col("doc").alias("node"), F.col("n_shingles").alias("n"), "registers")
    banded = _banded(nodes)
    keys = banded.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
    keys = stored(keys.filter("leader < last").select("key", "leader"), "keys")
    members = stored(banded.join(_small(keys, small_rows), "key"), "members")
    wanted = stored(members.select("node").distinct(), "wanted")
    registers = stored(nodes.join(_small(wanted, small_rows), "node", "left_semi"), "registers")
    pairs = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    near = stored(_near(pairs.distinct(), registers, percent), "near")
    sets = stored(_sets(docs, stored(_ends(near), "ends"), size), "sets")
    links = stored(_linked(near, sets, percent), "links")
    # A cluster: what sketches hold together.  It contains the components that links make so far.
    cluster = stored(components(near, work, "near").withColumnRenamed("component", "cluster"), "clusters")
    label = components(links, work, "first")
    clustered = cluster.join(label, "node", "left").select(
        F.col("cluster").alias("key"), "node", F.coalesce("component", "node").alias("component")
    )
    clustered = stored(clustered, "clustered")
    inner = stored(_within(clustered, sets, block_rows, percent, f"{work}/within"), "inner")
    named = members.select("key", "node").join(cluster, "node", "left")
    named = named.select("key", "node", F.coalesce("cluster", "node").alias("component"))
    parted = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    parted = stored(parted.filter("low <> high").select("key"), "parted")
    open_ = stored(named.join(parted, "key"), "open")
    across = _across(open_.join(registers, "node"), block_rows, percent, f"{work}/across-per")
    across = stored(across, "across")
    more_ends = stored(_ends(across).join(sets, "node", "left_anti"), "more-ends")
    more_sets = stored(_sets(docs, more_ends, size), "more-sets")
    outer = stored(_linked(across, sets.unionByName(more_sets), percent), "outer")
    label = components(links.unionByName(inner).unionByName(outer), work, "all")
    told = sketched.select("doc", "doc_id", "n_shingles").join(copies, "doc", "left")
    told = told.withColumn("node", F.coalesce("node", "doc")).join(label, "node", "left")
    return told.select("doc", "doc_id", "n_shingles", F.coalesce("component", "node").alias("first"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc", F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").alias("text"))


def groups(
    docs: DataFrame, size: int = 5, percent: int = 80, block_rows: int = BLOCK_ROWS, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that links lead to; its row is kept.
    """
    work = fresh_dir(docs.sparkSession, "near-dedup")
    rows, plain = numbered(docs.select("doc_id", "text"), work)
    found = _grouped(_texts(rows), work, size, percent, block_rows, small_rows)
    component = F.col("first")
    if not plain:
        ids = rows.select(F.col("doc").alias("first"), F.col("row.doc_id").cast("bigint").alias("component_id"))
        found, component = found.join(ids, "first"), F.col("component_id")
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc") == F.col("first")).alias("kept")
    )


def kept_rows(docs: DataFrame, size: int = 5, percent: int = 80, small_rows: int = SMALL_ROWS) -> DataFrame:
    """``docs`` with one document of each group, all columns as they were."""
    spark, work = docs.sparkSession, fresh_dir(docs.sparkSession, "near-kept")
    rows, _ = numbered(docs, work)
    found = _grouped(_texts(rows), work, size, percent, BLOCK_ROWS, small_rows)
    found.filter("doc <> first").select("doc").write.parquet(f"{work}/dropped")
    dropped = spark.read.schema("doc bigint").parquet(f"{work}/dropped")
    return without(rows, dropped, "doc").select("row.*")
