"""Chat formatting into prefix trees.

Conversations are sorted by their path, the list of (role, text) hashes of their turns, over
all partitions; in that order conversations with the same first turns are neighbours, which is
the depth-first order of the prefix tree. Each task walks its range and starts a new sequence
when the first turn changes or the sequence is full; within a sequence a turn that the
conversation shares with the one before is not emitted again. A first turn of a third of all
conversations thus spreads over many tasks and sequences, its shared text once in each.

Template: `<s>role\\n text </s>` for each turn. A control string inside a role or text gets a
backslash after its first character and backslashes are doubled, which `unescape` undoes.

A sequence row holds its text and its nodes: start and end of each turn's characters, the
parent node, the position id of its first character (the characters before it on its path),
the intervals of the ancestors that it attends to besides its own past, the intervals under
the loss (escaped assistant texts), and the last node of each conversation.

Defined cases: null text or role is empty; turns go by turn, null first, then role and text;
repeated rows are turns of their own; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that the template or a tokenizer of chats may read as control.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_SPLIT = re.compile(r"<s>(.*?)\n(.*?)</s>", re.S)

SEQUENCE = """sequence_id string, text string,
    nodes array<struct<start: long, end: long, parent: int, position: long, role: string,
                       text_start: long, text_end: long, ancestors: array<struct<start: long, end: long>>>>,
    loss array<struct<start: long, end: long>>,
    leaves array<struct<conv_id: long, node: int>>"""


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    while True:
        out = _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
        if out == text:
            return out
        text = out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def conversation_paths(turns: DataFrame) -> DataFrame:
    """conv_id, its turns in order, and the path that sorts the prefix tree."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    )


class _Tree:
    """One sequence being built; its open path is the last conversation's."""

    def __init__(self, name: str):
        self.name, self.parts, self.size = name, [], 0
        self.nodes: list[dict] = []
        self.path: list[tuple[str, str, int]] = []
        self.leaves: list[dict] = []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        depth = 0
        while depth < min(len(turns), len(self.path)) and self.path[depth][:2] == turns[depth]:
            depth += 1
        del self.path[depth:]
        for role, text in turns[depth:]:
            up = [self.nodes[k] for _, _, k in self.path]
            head, body = f"<s>{escape(role)}\n", escape(text)
            piece = f"{head}{body}</s>"
            self.nodes.append({
                "start": self.size, "end": self.size + len(piece), "parent": self.path[-1][2] if self.path else -1,
                "position": sum(n["end"] - n["start"] for n in up), "role": role,
                "text_start": self.size + len(head), "text_end": self.size + len(head) + len(body),
                "ancestors": [{"start": n["start"], "end": n["end"]} for n in up],
            })
            self.path.append((role, text, len(self.nodes) - 1))
            self.parts.append(piece)
            self.size += len(piece)
        self.leaves.append({"conv_id": conv_id, "node": self.path[-1][2]})

    def row(self) -> dict:
        loss = [{"start": n["text_start"], "end": n["text_end"]} for n in self.nodes if n["role"] == "assistant"]
        return {"sequence_id": self.name, "text": "".join(self.parts), "nodes": self.nodes, "loss": loss, "leaves": self.leaves}


def format_trees(turns: DataFrame, *, sequence_chars: int = 65_536) -> DataFrame:
    """turns(conv_id, turn, role, text) as sequences of prefix trees, see SEQUENCE."""

    def build(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, n, tree, done, held = TaskContext.get().partitionId(), 0, None, [], 0
        interval = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        node = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("parent", pa.int32()), ("position", pa.int64()), ("role", pa.string()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("ancestors", interval)])
        leaf = pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])
        schema = pa.schema([("sequence_id", pa.string()), ("text", pa.string()), ("nodes", pa.list_(node)), ("loss", interval), ("leaves", pa.list_(leaf))])
        for batch in batches:
            for row in batch.to_pylist():
                said = [(t["role"], t["text"]) for t in row["turns"]]
                if tree and (tree.size >= sequence_chars or len(tree.leaves) >= 4096 or tree.path[0][:2] != said[0]):
                    done.append(tree.row())
                    held += tree.size
                    tree = None
                if tree is None:
                    tree, n = _Tree(f"{part:06d}-{n:08d}"), n + 1
                tree.add(row["conv_id"], said)
                if held > 4_000_000:
                    yield pa.RecordBatch.from_pylist(done, schema=schema)
                    done, held = [], 0
        if tree:
            done.append(tree.row())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    order = ["path", "conv_id"]
    placed = conversation_paths(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select("conv_id", "turns").mapInArrow(build, SEQUENCE)


def read_trees(sequences: DataFrame) -> DataFrame:
    """What a trainer would see of each conversation, from the sequences alone.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: the text is parsed
    at its own control strings along the conversation's path; nodes give places, not contents.
    """

    def read(batches):
        import pyarrow as pa

        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        schema = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names])
        for batch in batches:
            for row in batch.to_pylist():
                text, nodes, out = row["text"], row["nodes"], []
                loss = {(x["start"], x["end"]) for x in row["loss"]}
                for leaf in row["leaves"]:
                    last = nodes[leaf["node"]]
                    own = [*last["ancestors"], {"start": last["start"], "end": last["end"]}]
                    said, learned, n, size = hashlib.sha256(), hashlib.sha256(), 0, 0
                    chars = 0
                    for x in own:
                        piece = text[x["start"] : x["end"]]
                        chars += len(piece)
                        for m in _SPLIT.finditer(piece):
                            said.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                            n += 1
                            if (x["start"] + m.start(2), x["start"] + m.end(2)) in loss:
                                answer = unescape(text[x["start"] + m.start(2) : x["start"] + m.end(2)])
                                learned.update(answer.encode())
                                size += len(answer)
                    out.append((leaf["conv_id"], n, said.hexdigest(), size, learned.hexdigest(), chars))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return sequences.mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
