"""Merkle manifest of a dataset: a proof for each document, folded by cogrouped subtrees.

Every document is a leaf: the SHA-256 of its fields.  The leaves of a language are ordered by
``doc_id`` and reduced eight by eight to the language's subroot, the subroots to the root.  A
*superblock* is 4,096 (8 to the 4th) consecutive nodes of one tree: its local tree needs no other
node, so

* upwards, superblocks are reduced to one node each, which are the nodes of the next round,
* downwards, the nodes of a superblock are cogrouped with its outer nodes, the siblings on the way
  from its top to the root; that one task finishes the local reduction, joins the local siblings
  with the outer ones to proofs, and folds the proofs.

A round divides the nodes by 4,096, so three rounds do for 68 billion documents.  The driver sees
whether another round is needed.  A language that holds most documents has more superblocks.

Defined cases: a null field is ``-``; an empty text is ``0:``; a document without ``doc_id`` precedes
the others of its language, is never tampered with, and equal ids are ordered by their leaves;
repeated rows are leaves of their own; a null language is a tree of its own and precedes all; a
single leaf is its subroot, and a single subroot the root; an empty table gives no rows; other
columns play no part.  Texts are hashed whole, in the JVM, and never travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.ranking import ranked, stored
from millrace.scratch import fresh_dir

FAN = 8
DEPTH = 4  # levels of a superblock
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODE = "key string, place bigint, total bigint, digest binary"
OUTER = "key string, place bigint, steps array<int>, proof string, subroot string, root string"
AUDIT = (
    "doc_id string, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def _field(value: Column) -> Column:
    text = value.cast("string")
    sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(sized, F.lit("-"))


def leaf(text: Column) -> Column:
    """The 32 bytes of a document's leaf, with ``text`` in the place of its text."""
    parts = [_field(text if name == "text" else F.col(name)) for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _joined(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def local_tree(nodes: pd.DataFrame, depth: int) -> list[list[str]]:
    """The levels of a superblock, bottom up: to one node if its tree has no other superblock, else
    ``depth`` levels more.  ``nodes`` are in order."""
    levels = [[digest.hex() for digest in nodes["digest"]]]
    alone = nodes["total"].iloc[0] <= FAN**depth
    while len(levels[-1]) > 1 if alone else len(levels) <= depth:
        row = levels[-1]
        levels.append([_joined(row[i : i + FAN]) for i in range(0, len(row), FAN)])
    return levels


def siblings(levels: list[list[str]], at: int) -> Iterator[tuple[int, list[str]]]:
    """For each level below the top, the node's place in its run and the run's other nodes."""
    for row in levels[:-1]:
        run, place = at // FAN * FAN, at % FAN
        others = row[run : run + FAN]
        del others[place]
        yield place, others
        at //= FAN


def folded(node: str, steps: list[int], proof: str) -> str:
    """The root that a node and its proof lead to; ``steps`` has place and number of siblings by level."""
    at = 0
    for place, count in zip(steps[::2], steps[1::2]):
        split, end = at + 64 * place, at + 64 * count
        node = _joined([proof[at:split], node, proof[split:end]])
        at = end
    return node


@dataclass
class Subtree:
    """A superblock with its outer nodes: what one cogroup brings together."""

    levels: list[list[str]]
    steps: list[int]
    proof: str

    @staticmethod
    def of(nodes: pd.DataFrame, outer: pd.DataFrame, depth: int) -> Subtree:
        steps = [int(step) for step in outer["steps"].iloc[0]]
        return Subtree(local_tree(nodes, depth), steps, outer["proof"].iloc[0])

    def path(self, at: int) -> tuple[list[int], str]:
        """Steps and proof of a node from its level to the root."""
        steps, proof = [], []
        for place, others in siblings(self.levels, at):
            steps += [place, len(others)]
            proof += others
        return steps + self.steps, "".join(proof) + self.proof


def _dealt(rows: DataFrame, block: Column) -> DataFrame:
    """Rows by superblock over a stated number of tasks: few bytes, but real work."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("block", block).repartition(parts, "key", "block")


def _by_superblock(nodes: DataFrame, depth: int) -> DataFrame:
    return _dealt(nodes, F.floor(F.col("place") / FAN**depth).cast("bigint"))


def _reduced(nodes: pd.DataFrame, depth: int) -> pd.DataFrame:
    nodes = nodes.sort_values("place")
    return pd.DataFrame(
        {
            "key": [nodes["key"].iloc[0]],
            "place": [nodes["block"].iloc[0]],
            "total": [-(-int(nodes["total"].iloc[0]) // FAN**depth)],
            "digest": [bytes.fromhex(local_tree(nodes, depth)[-1][0])],
        }
    )


def grown(nodes: DataFrame, work: str, name: str, depth: int) -> list[DataFrame]:
    """``nodes`` and, round by round, the tops of their superblocks; in the last every tree has one node."""
    rounds = [nodes.select("key", "place", "total", "digest")]
    while True:
        below = rounds[-1] if len(rounds) == 1 else rounds[-1].filter("total > 1")
        blocks = _by_superblock(below, depth).groupBy("key", "block")
        tops = blocks.applyInPandas(lambda rows: _reduced(rows, depth), NODE)
        rounds.append(stored(tops, f"{work}/{name}-{len(rounds)}"))
        if rounds[-1].filter("total > 1").isEmpty():
            return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """``key`` and ``digest`` of every tree."""
    found = rounds[1].filter("total = 1")
    for tops in rounds[2:]:
        found = found.unionByName(tops.filter("total = 1"))
    return found.select("key", "digest")


def _paths(nodes: pd.DataFrame, outer: pd.DataFrame, depth: int) -> pd.DataFrame:
    """``OUTER`` for each node of a superblock."""
    nodes = nodes.sort_values("place").reset_index(drop=True)
    tree = Subtree.of(nodes, outer, depth)
    rest = outer["subroot"].iloc[0], outer["root"].iloc[0]
    places = zip(nodes["key"], nodes["place"])
    rows = [(key, place, *tree.path(at), *rest) for at, (key, place) in enumerate(places)]
    return pd.DataFrame(rows, columns=[part.split()[0] for part in OUTER.split(", ")])


def _tops(nodes: pd.DataFrame, outer: pd.DataFrame, depth: int) -> pd.DataFrame:
    """``OUTER`` for the trees whose tops these nodes are: place 0 of the tree ``name``."""
    nodes = nodes.sort_values("place").reset_index(drop=True)
    subroots = [digest.hex() for digest in nodes["digest"]]
    return _paths(nodes, outer, depth).assign(key=nodes["name"], place=0, subroot=subroots)


def _audited(nodes: pd.DataFrame, outer: pd.DataFrame, depth: int) -> pd.DataFrame:
    nodes = nodes.sort_values("place").reset_index(drop=True)
    tree, root, rows = Subtree.of(nodes, outer, depth), outer["root"].iloc[0], []
    for at, (doc_id, found) in enumerate(zip(nodes["doc_id"], nodes["found"])):
        steps, proof = tree.path(at)
        own = tree.levels[0][at]
        end = folded(own if found is None else found.hex(), steps, proof)
        digest = hashlib.sha256(proof.encode()).hexdigest()
        rows.append((doc_id, own, outer["subroot"].iloc[0], root, digest, end, end == root))
    return pd.DataFrame(rows, columns=[part.split()[0] for part in AUDIT.split(", ")])


def _cogrouped(nodes: DataFrame, outer: DataFrame, work: Callable, schema: str, depth: int) -> DataFrame:
    sides = _by_superblock(nodes, depth), _dealt(outer, F.col("place"))
    left, right = (side.groupBy("key", "block") for side in sides)
    return left.cogroup(right).applyInPandas(lambda a, b: work(a, b, depth), schema)


def descended(rounds: list[DataFrame], tops: DataFrame, work: str, name: str, depth: int) -> DataFrame:
    """The outer nodes of the superblocks of ``rounds[0]``, from those of the trees' tops."""
    own = ["steps", "proof", "subroot", "root"]
    outer = None
    for number in range(len(rounds) - 1, 0, -1):
        ended = rounds[number].filter("total = 1").select("key", "place").join(tops.select("key", *own), "key")
        if outer is not None:
            below = _cogrouped(rounds[number].filter("total > 1"), outer, _paths, OUTER, depth)
            ended = ended.unionByName(stored(below, f"{work}/{name}-{number}-outer"))
        outer = ended
    return outer


@dataclass(frozen=True)
class Manifest:
    """Stored trees: the leaves, the rounds of each language's tree, and those of the root's tree."""

    leaves: DataFrame
    languages: list[DataFrame]
    subroots: DataFrame
    above: list[DataFrame]
    work: str
    depth: int

    @staticmethod
    def build(docs: DataFrame, found_text: Column, depth: int = DEPTH) -> Manifest:
        """``found_text`` is the text as it is found later, null where it is as it was."""
        work = fresh_dir(docs.sparkSession, "manifest")
        leaves = docs.select(
            F.col("doc_id").cast("string").alias("doc_id"),  # pandas has no integers with nulls
            F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("key"),
            leaf(F.col("text")).alias("digest"),
            F.when(found_text.isNotNull(), leaf(found_text)).alias("found"),
        )
        leaves = stored(leaves.withColumn("_row", F.monotonically_increasing_id()), f"{work}/leaves")
        order = [F.col("doc_id").cast("bigint").asc_nulls_first(), F.col("digest").asc()]
        leaves = ranked(leaves, order, f"{work}/ordered", group="key")
        languages = grown(leaves, work, "languages", depth)
        tops = roots(languages).withColumn("_row", F.lit(0))
        ordered = ranked(tops, [F.col("key").asc()], f"{work}/subroots")
        subroots = ordered.select(F.lit("").alias("key"), F.col("key").alias("name"), "place", "total", "digest")
        return Manifest(leaves, languages, subroots, grown(subroots, work, "root", depth), work, depth)

    def root(self) -> DataFrame:
        """One row with the root as ``digest``; none for an empty table."""
        return roots(self.above)

    def audit(self) -> DataFrame:
        """``AUDIT`` for every document: its place in the manifest, and whether it can be verified."""
        root = self.root().select(
            "key",
            F.expr("CAST(array() AS array<int>)").alias("steps"),
            F.lit("").alias("proof"),
            F.lit("").alias("subroot"),
            F.lower(F.hex("digest")).alias("root"),
        )
        above = descended(self.above, root, self.work, "above", self.depth)
        tops = _cogrouped(self.subroots, above, _tops, OUTER, self.depth)
        tops = stored(tops, f"{self.work}/tops")
        outer = descended(self.languages, tops, self.work, "below", self.depth)
        found = _cogrouped(self.leaves, outer, _audited, AUDIT, self.depth)
        return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def lowered_every_third() -> Column:
    """The text in lower case (A-Z) where 3 divides the CRC-32 of the decimal id, else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(chosen, lowered)
