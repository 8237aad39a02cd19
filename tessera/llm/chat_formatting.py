"""Chat formatting over prefix trees.

Conversations that share their first turns share those turns' tokens: the distinct conversations of
one first turn form a tree, written depth-first with each node once. A token's position id counts
along its path, and it attends to the intervals of its ancestors and to its own node up to itself.

A tree is written in pieces that one task can hold. A turn that conversations of more than ``part``
weight share is a piece of its own, the trunk; the subtrees that hang on a trunk turn are dealt into
pieces of about ``part`` weight, whole. Subtrees beside each other share no turn but the trunk, so
every shared turn is still written once. A piece names the trunk pieces above it: its tokens attend
to all of theirs, and its positions go on from them. A conversation weighs one, and one more for
every ``UNIT`` characters.

Equal conversations are one leaf. One conversation is one record, as its digest and its token
sequence are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, col, drop_stash, stash, table

START, END = "<|im_start|>", "<|im_end|>"
UNIT = 8192
SALTS = 16  # places in which rows of a hot turn or conversation meet what is known of it
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """No ``<|`` is left in the result, so no text can pass for a control string."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as the template writes it, and where its text begins and ends."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


NODE = pa.struct([("parent", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("exit", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("ancestors", pa.list_(pa.list_(pa.int64()))), ("token_start", pa.int64()), ("token_end", pa.int64())])
LEAF = pa.struct([("path", pa.string()), ("node", pa.int32())])
TREE_SCHEMA = (
    "piece string, above array<string>, text string, "
    "nodes array<struct<parent:int,start:bigint,end:bigint,position:bigint,exit:bigint,loss_start:bigint,loss_end:bigint,ancestors:array<array<bigint>>,token_start:bigint,token_end:bigint>>, "
    "leaves array<struct<path:string,node:int>>, token_ids array<int>, position_ids array<int>"
)


def _grown(intervals: list[list[int]], start: int, end: int) -> list[list[int]]:
    """Intervals with one more behind them; neighbours are one."""
    if intervals and intervals[-1][1] == start:
        return [*intervals[:-1], [intervals[-1][0], end]]
    return [*intervals, [start, end]]


def build_tree(members: list[tuple[str | None, list[tuple[str, str]]]], encode=None, depth: int = 0) -> dict:
    """One piece from (path, turns): its text depth-first, its nodes in that order, and its leaves.

    The first depth turns, which all members share, are written elsewhere and count for positions
    alone. A member without a path is no leaf.
    """
    nodes, chunks, leaves, tokens, positions = [], [], [], [], []

    def coded(chunk: str):
        ids = encode(chunk) if encode else None
        return ids, len(ids) if encode else len(chunk)

    above = sum(coded(format_turn(*t)[0])[1] for t in members[0][1][:depth])
    at = token_at = 0
    path_nodes: list[int] = []
    seen: list[tuple[str, str]] = []
    for path, turns in sorted(members, key=lambda m: m[1]):  # in this order a depth-first walk never goes back
        turns = turns[depth:]
        shared = 0
        while shared < min(len(seen), len(turns)) and seen[shared] == turns[shared]:
            shared += 1
        for k in path_nodes[shared:]:
            nodes[k]["exit"] = at
        del path_nodes[shared:]
        for role, text in turns[shared:]:
            chunk, a, b = format_turn(role, text)
            ids, n = coded(chunk)
            up = nodes[path_nodes[-1]] if path_nodes else None
            position = up["position"] + up["token_end"] - up["token_start"] if up else above
            lose = role == "assistant"
            nodes.append(
                {"parent": path_nodes[-1] if up else -1, "start": at, "end": at + len(chunk), "position": position, "exit": 0, "loss_start": at + a if lose else None, "loss_end": at + b if lose else None}
                | {"ancestors": _grown(up["ancestors"], up["token_start"], up["token_end"]) if up else [], "token_start": token_at, "token_end": token_at + n}
            )
            if encode:
                tokens += ids
                positions += range(position, position + n)
            path_nodes.append(len(nodes) - 1)
            chunks.append(chunk)
            at, token_at = at + len(chunk), token_at + n
        seen = turns
        if path is not None:
            leaves.append({"path": path, "node": path_nodes[-1]})
    for k in path_nodes:
        nodes[k]["exit"] = at
    return {"text": "".join(chunks), "nodes": nodes, "leaves": leaves, "token_ids": tokens if encode else None, "position_ids": positions if encode else None}


def conversations_of(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turns, steps, path): digests of the first turns, for each number of them, and of all."""
    row = F.struct(col(turn_col).alias("turn"), F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    convs = turns.groupBy(col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("t"))
    convs = convs.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))

    def step(acc, turn):
        return F.concat(acc, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), F.to_json(turn)), 256)))

    convs = convs.withColumn("steps", F.aggregate("turns", F.array().cast("array<string>"), step))
    return stash(convs.withColumn("path", F.element_at("steps", -1)), "conversations")


def _spread(facts: DataFrame) -> DataFrame:
    return facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def _salt(*by: str):
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


def pieces_of(convs: DataFrame, part: int) -> DataFrame:
    """(piece, above, members): which turns and conversations each piece writes; above names the trunk pieces before it."""
    distinct = convs.groupBy("path").agg(F.first("steps").alias("steps"), F.first("turns").alias("turns"))
    whole = stash(distinct.withColumn("w", 1 + F.length(F.to_json("turns")) / UNIT), "paths")
    steps = whole.select("path", "w", F.posexplode("steps").alias("k", "step"))
    trunk = stash(steps.groupBy("step").agg(F.sum("w").alias("held"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("held") > part)).drop("n"), "trunk")
    member = F.struct("path", "turns").alias("members")
    if trunk.isEmpty():
        parts = whole.groupBy(F.get("steps", F.lit(0)).alias("piece")).agg(F.collect_list(F.struct("path", "turns")).alias("members"))
        return parts.select("piece", F.array().cast("array<string>").alias("above"), "members")
    met = stash(steps.withColumn("_salt", _salt("path")).join(_spread(trunk), ["step", "_salt"]).select("path", "k", "step", "held"), "trunk-paths")
    depth = met.groupBy("path").agg((F.max("k") + 1).alias("depth"), F.max_by("held", "k").alias("held"))
    placed = whole.join(depth, "path", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    own = F.get("steps", F.col("depth"))
    dealt = F.concat(F.get("steps", F.col("depth") - 1), F.lit(":"), F.pmod(F.xxhash64(own), F.ceil(F.col("held") / part)).cast("string"))
    parts = placed.where(F.col("depth") < F.size("steps")).withColumns({"piece": F.when(F.col("depth") == 0, own).otherwise(dealt), "above": F.slice("steps", F.lit(1), F.col("depth"))})
    parts = parts.groupBy("piece").agg(F.first("above").alias("above"), F.collect_list(F.struct("path", "turns")).alias("members"))
    one = met.groupBy("step", "k").agg(F.min("path").alias("path"), F.max(F.col("path") == F.col("step")).alias("leaf"))
    turns = one.join(whole.select("path", "steps", "turns"), "path").withColumn("turns", F.slice("turns", F.lit(1), F.col("k") + 1))
    turns = turns.withColumn("path", F.when(F.col("leaf"), F.col("step")))
    turns = turns.select(F.col("step").alias("piece"), F.slice("steps", F.lit(1), F.col("k")).alias("above"), F.array(member).alias("members"))
    return parts.unionByName(turns)


def format_trees(convs: DataFrame, part: int = 512, tokenizer_path: str | None = None) -> DataFrame:
    """One row for each piece of a tree: text, nodes and leaves, and token ids if a tokenizer is given.

    convs: what conversations_of() returns. Without a tokenizer a token is a code point, and the
    position ids of a node count up from its ``position``. Node i's tokens attend to all tokens of the
    pieces ``above``, to all of its ``ancestors`` intervals, where neighbours are merged, and to their
    own node up to themselves.
    """
    bound_batches(convs.sparkSession)
    trees = pieces_of(convs, part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        if tokenizer_path:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(tokenizer_path)
            encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        columns = {"piece": pa.string(), "above": pa.list_(pa.string()), "text": pa.string(), "nodes": pa.list_(NODE), "leaves": pa.list_(LEAF), "token_ids": pa.list_(pa.int32()), "position_ids": pa.list_(pa.int32())}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                row |= build_tree([(m["path"], [(t["role"], t["text"]) for t in m["turns"]]) for m in row["members"]], encode, len(row["above"]))
                yield pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in columns.items()], names=list(columns))

    return trees.mapInArrow(run, TREE_SCHEMA)


DIGEST = {"path": pa.string(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def with_trunk(trees: DataFrame) -> DataFrame:
    """trees with trunk: text, and the text under the loss mask, of each piece above, from the top."""
    none = F.array().cast("array<struct<k:int,text:string,loss_start:bigint,loss_end:bigint>>")
    if trees.where("size(above) > 0").isEmpty():
        return trees.withColumn("trunk", none)
    node = F.get("nodes", F.lit(0))
    named = trees.select("piece", F.posexplode("above").alias("k", "step")).withColumn("_salt", _salt("piece"))
    said = trees.join(named.select("step").distinct(), trees["piece"] == F.col("step"), "left_semi")
    said = said.select(F.col("piece").alias("step"), "text", node["loss_start"].alias("loss_start"), node["loss_end"].alias("loss_end"))
    trunk = named.join(_spread(said), ["step", "_salt"]).groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("k", "text", "loss_start", "loss_end"))).alias("trunk"))
    return trees.join(trunk, "piece", "left").withColumn("trunk", F.coalesce("trunk", none))


def read_back(trees: DataFrame) -> DataFrame:
    """One row for each leaf, from the written trees alone: the turns and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = []
                tree = batch.slice(i, 1).to_pylist()[0]
                text, nodes = tree["text"], tree["nodes"]
                above = "".join(t["text"] for t in tree["trunk"])
                lost_above = "".join(unescape(t["text"][t["loss_start"] : t["loss_end"]]) for t in tree["trunk"] if t["loss_start"] is not None)
                for leaf in tree["leaves"]:
                    chain, k = [], leaf["node"]
                    while k >= 0:
                        chain.append(nodes[k])
                        k = nodes[k]["parent"]
                    chain.reverse()
                    formatted = above + "".join(text[n["start"] : n["end"]] for n in chain)
                    turns = read_turns(formatted)
                    lost = lost_above + "".join(unescape(text[n["loss_start"] : n["loss_end"]]) for n in chain if n["loss_start"] is not None)
                    whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                    digest = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (whole, lost)]
                    out.append((leaf["path"], len(turns), digest[0], len(lost), digest[1], len(formatted)))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(DIGEST.values())], names=list(DIGEST))

    read = with_trunk(trees).select("text", "nodes", "leaves", "trunk")
    return read.mapInArrow(run, "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_format(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = 512, tokenizer_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(trees, index): the written trees, and for each conversation the path that is its leaf.

    Turns go by turn, then role and text where turns repeat or are null (null first). Null roles and
    texts count as empty; rows with a null conv_id form one conversation; other columns are left
    out. An empty table gives no trees.
    """
    convs = conversations_of(turns, conv_col, turn_col, role_col, text_col)
    return format_trees(convs, part, tokenizer_path), convs.select("conv_id", "path")


def op2_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{END}{START}assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    trees, index = chat_format(rows)
    written = stash(trees.drop("token_ids", "position_ids"), "chat-trees")
    read = stash(read_back(written), "chat-read")
    drop_stash(written)
    return index.withColumn("_salt", _salt("conv_id")).join(_spread(read), ["path", "_salt"]).drop("path", "_salt")
