"""Chat formatting into prefix trees.

Template: a turn is ``<|im_start|>``, role, line feed, text, ``<|im_end|>``, line feed. Control strings inside roles and
texts get a backslash after their first character, backslashes are doubled, and a line feed in a role becomes ``<|nl|>``;
so no text can open or close a turn, and reading back undoes it. Positions are code points of the formatted text.

Prefix tree: a node is a distinct sequence of turns, named by a chained hash, so conversations that share initial turns
share nodes. A node belongs to the smallest conversation that passes through it; below the point where a conversation
leaves the others, all its nodes are its own: its branch. The tree of branches has one row a conversation, and its
ancestors are found by doubling. Emission is depth-first: a branch from its first turn to its last, then the branches
that leave it, the deepest first. A node is emitted once, with its place in the stream, the position id of its first
code point (what precedes it on its path), and the intervals of the stream that it may attend to: parts of its ancestor
branches, and its own branch before it. The loss mask is the texts of assistant turns.

No step gathers a tree, a branch or a conversation: turns stream in order of conversation, stream offsets are running
sums over a range-sorted table of branches, and read-back joins single turns. A turn that very many conversations share, a
branch that very many leave and one that is on very many paths are salted in every join.

Defined cases: null text is empty, null role is an empty role; rows without conversation id are left out; equal turns of a
conversation are ordered by role, then text; equal conversations share all nodes; a conversation that is the beginning of
another has no branch of its own; an empty table gives no rows; other input columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALT, Spread, cut, parts_for, tidy, written
from .sharding import numbered

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
# Strings that common templates give a meaning.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|nl|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_BACK = re.compile(r"\\(\\?)")
ROOT = b"\0" * 16


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends."""
    head = START + escape(role).replace("\n", BREAK) + "\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    if not formatted.startswith(START) or not formatted.endswith(END):
        raise ValueError("not a formatted turn")
    role, _, body = formatted[len(START) : -len(END)].partition("\n")
    return unescape(role.replace(BREAK, "\n")), unescape(body)


TURNS = "conv long, idx int, node binary, pos long, chars int, body_from int, body_to int, loss boolean, piece string"


def turns_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn; what is carried over is one hash and two numbers."""
    conv, node, idx, pos = None, ROOT, 0, 0
    for b in batches:
        out: list[list] = [[] for _ in range(9)]
        for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if c != conv:
                conv, node, idx, pos = c, ROOT, 0, 0
            piece, a, z = format_turn(role or "", text or "")
            node = hashlib.blake2b(node + piece.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            for x, v in zip(out, (c, idx, node, pos, len(piece), a, z, role == "assistant", piece), strict=True):
                x.append(v)
            idx += 1
            pos += len(piece)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["conv", "idx", "node", "pos", "chars", "body_from", "body_to", "loss", "piece"])


def prefix_trees(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", per_salt: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves). A node or branch that more than per_salt rows look up is salted.

    nodes: branch, idx (turn from 0 on its path), start (place in the stream), chars, position (id of its first code
    point), attends (intervals [start, end) of the stream before it on its path), loss_from and loss_to (mask within the
    node, null outside assistant turns), piece (formatted turn).
    leaves: conv, branch and last (the turn of that branch that ends it), turns, chars, path (for each branch on the way:
    branch, first turn, last turn).
    """
    rows = conversations.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")).where("conv is not null")
    parts = parts_for(conversations)
    order = ["conv", "turn", "role", "text"]
    turns = written(rows.repartition(parts, "conv").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order]).select("conv", "role", "text").mapInArrow(tidy(turns_in_order), TURNS))

    owners = cut(turns.groupBy("node").agg(F.min("conv").alias("owner"), F.count("*").alias("uses")))
    owned = Spread(owners, "node", "uses", per_salt).join(turns.select("conv", "idx", "node", "chars"), owners.select("node", "owner"), "conv")
    own = F.col("owner") == F.col("conv")
    per = cut(
        owned.groupBy("conv").agg(
            F.min(F.when(own, F.col("idx"))).alias("from"),
            F.max("idx").alias("last"),
            F.sum("chars").alias("chars"),
            F.sum(F.when(own, F.col("chars"))).alias("own_chars"),
            # the deepest node that is another's: the largest index among them
            F.max(F.when(~own, F.struct("idx", "owner"))).alias("shared"),
        )
    )
    branches = per.where("`from` is not null").select(
        F.col("conv").alias("branch"), F.col("from"), (F.col("chars") - F.col("own_chars")).alias("position"), "own_chars", F.col("shared.owner").alias("parent"), F.col("shared.idx").alias("leaves_at")
    )

    def joined(many: DataFrame, one: DataFrame, key: str, how: str = "left") -> DataFrame:
        """one has a row for each key; where many rows of the other side share a key, they are salted. Rows without key,
        such as the branches that leave the root, aren't shuffled."""
        known = many.where(F.col(key).isNotNull())
        uses = cut(known.groupBy(key).agg(F.count("*").alias("uses")))
        out = Spread(uses, key, "uses", per_salt).join(known, one, "branch", how=how)
        return out.unionByName(many.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out

    # ancestors, from the root down, by doubling: everyone's list is put after the list of the branch at its head. A step
    # ends where the next branch on the way begins, so its end needs no look-up.
    of_parent = branches.select(F.col("branch").alias("parent"), F.col("from").alias("parent_from"), F.col("position").alias("parent_position"))
    step = F.struct(F.col("parent").alias("branch"), F.col("parent_from").alias("from"), F.col("parent_position").alias("position"), F.col("leaves_at").alias("last"), F.col("position").alias("until"))
    no_steps = F.expr("cast(array() as array<struct<branch:bigint,from:int,position:bigint,last:int,until:bigint>>)")
    up = cut(joined(branches, of_parent, "parent").select("branch", F.col("parent").alias("head"), F.when(F.col("parent").isNotNull(), F.array(step)).otherwise(no_steps).alias("above")))
    while up.where("head is not null").limit(1).count():
        head = up.select(F.col("branch").alias("head"), F.col("head").alias("higher"), F.col("above").alias("more"))
        up = cut(joined(up, head, "head").select("branch", F.col("higher").alias("head"), F.when(F.col("more").isNotNull(), F.concat("more", "above")).otherwise(F.col("above")).alias("above")))
    # depth-first order: the way down as (minus the turn at which it leaves, branch); arrays sort a beginning first
    way = F.transform(
        F.sequence(F.lit(0), F.size("above")),
        lambda i: F.struct(F.when(i > 0, -F.try_element_at("above", i)["last"]).otherwise(F.lit(0)).alias("o"), F.coalesce(F.try_element_at("above", i + 1)["branch"], F.col("branch")).alias("b")),
    )
    placed = branches.join(up.select("branch", "above"), "branch").withColumn("way", way)
    placed = cut(numbered(placed, ["way"], "stream_order", "own_chars", "start").drop("way", "stream_order"))

    # where each ancestor's part lies in the stream
    steps = placed.select("branch", F.posexplode("above").alias("i", "step")).select("branch", "i", F.col("step.branch").alias("above"), (F.col("step.until") - F.col("step.position")).alias("size"))
    spots = joined(cut(steps), placed.select(F.col("branch").alias("above"), F.col("start").alias("above_start")), "above", "inner")
    interval = F.struct("i", F.col("above_start").alias("start"), (F.col("above_start") + F.col("size")).alias("end"))
    seen = spots.groupBy("branch").agg(F.array_sort(F.collect_list(interval)).alias("seen"))
    full = cut(placed.join(seen, "branch", "left"))

    mine = turns.join(full.select(F.col("branch").alias("conv"), F.col("from"), F.col("start").alias("branch_start"), F.col("position").alias("branch_position"), "seen"), "conv").where(F.col("idx") >= F.col("from"))
    start = F.col("branch_start") + F.col("pos") - F.col("branch_position")
    before = F.transform(F.coalesce("seen", F.expr("array()")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    nodes = mine.select(
        F.col("conv").alias("branch"), "idx", start.alias("start"), "chars", F.col("pos").alias("position"),
        F.when(F.col("idx") > F.col("from"), F.concat(before, F.array(F.struct(F.col("branch_start").alias("start"), start.alias("end"))))).otherwise(before).alias("attends"),
        F.when(F.col("loss"), F.col("body_from")).alias("loss_from"), F.when(F.col("loss"), F.col("body_to")).alias("loss_to"), "piece",
    )
    ends_in = cut(per.select("conv", F.when(F.col("from").isNotNull(), F.col("conv")).otherwise(F.col("shared.owner")).alias("branch"), "last", (F.col("last") + 1).alias("turns"), "chars"))
    bare = F.transform("above", lambda s: F.struct(s["branch"].alias("branch"), s["from"].alias("from"), s["last"].alias("last")))
    paths = full.select("branch", "from", bare.alias("path"))
    ends = Spread(cut(ends_in.groupBy("branch").agg(F.count("*").alias("uses"))), "branch", "uses", per_salt).join(ends_in, paths, "conv")
    leaves = ends.select("conv", "branch", "last", "turns", "chars", F.concat("path", F.array(F.struct("branch", "from", "last"))).alias("path"))
    return nodes, leaves


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn: formatted turns and masks, read back as they stream by."""
    state = None

    def done(s: list) -> tuple:
        return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

    def out(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names=[c.split()[0] for c in READ.split(", ")])

    for b in batches:
        found = []
        for conv, piece, a, z in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    found.append(done(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_turn(piece)
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if a is not None:
                masked = unescape(piece[a:z])
                state[3] += len(masked)
                state[4].update(masked.encode("utf-8", "surrogatepass"))
            state[5] += len(piece)
        if found:
            yield out(found)
    if state is not None:
        yield out([done(state)])


def read_back(nodes: DataFrame, leaves: DataFrame, per_salt: int = 1000) -> DataFrame:
    """Each conversation's turns, found through its path and read from the emitted nodes."""
    refs = leaves.select("conv", F.explode("path").alias("p")).select("conv", F.col("p.branch").alias("branch"), F.explode(F.sequence("p.from", "p.last")).alias("idx"))
    uses = cut(leaves.select(F.explode("path.branch").alias("branch")).groupBy("branch").agg(F.count("*").alias("uses")))
    spread = Spread(uses, "branch", "uses", per_salt)
    asked, there = spread.salted(refs, "conv"), spread.copied(nodes.select("branch", "idx", "piece", "loss_from", "loss_to"))
    found = asked.join(there, ["branch", "idx", SALT]).select("conv", "idx", "piece", "loss_from", "loss_to")
    parts = parts_for(leaves)
    return found.repartition(parts, "conv").sortWithinPartitions("conv", "idx").select("conv", "piece", "loss_from", "loss_to").mapInArrow(tidy(digests), READ)
