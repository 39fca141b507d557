"""Chat formatting as a forest of shared prefixes.

Every turn is formatted by a template of control strings; control strings inside a text
are escaped reversibly. Conversations that begin with the same turns share them: a turn
is a tree node named by the hash of all turns up to it, and is owned by the smallest
conversation that passes through it. What a conversation owns is always the end of its
path: its *segment*. :func:`emit` gives every segment once, depth-first, as token ids with
the position id its first token has on the path and the intervals of its ancestors that
it attends to; :func:`read_back` rebuilds every conversation from that output alone, by
following the intervals from the segment it ends in.

Tokens are those of a byte-pair vocabulary, or code points where none is given. A turn's
head, text and end are encoded by themselves, so the loss mask never cuts a token.

Turns are hashed in order by streaming over sorted partitions, holding one turn at a time,
so a conversation of any length needs no memory of its own. Joins are salted where many
conversations share a turn.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import bpe
from emberlog.llm.common import checkpointed, skew_join, stored

# The control strings of the template, in the order in which a turn uses them.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Control strings of other widely used templates; escaped as well, so that no reader takes a text for a control.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ASSISTANT = "assistant"

_CONTROL = re.compile("|".join(map(re.escape, (TURN, BODY, END, *FOREIGN))))
_CODE = {"<": "l", "[": "b", "\\": "\\"}
_PLAIN = {code: char for char, code in _CODE.items()}
_ESCAPED = re.compile(r"\\([lb\\])")


def escape(text: str | None) -> str:
    """``text`` without control strings: backslashes are doubled, a control string's first character is coded. Null counts as empty."""
    doubled = (text or "").replace("\\", "\\\\")
    while (found := _CONTROL.sub(lambda m: "\\" + _CODE[m[0][0]] + m[0][1:], doubled)) != doubled:
        doubled = found
    return doubled


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def parts_of_turn(role: str | None, text: str | None) -> tuple[str, str, str]:
    """A formatted turn in its three parts: head, text, end."""
    return f"{TURN}{escape(role)}{BODY}", escape(text), END


def format_turn(role: str | None, text: str | None) -> str:
    return "".join(parts_of_turn(role, text))


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, text = formatted.removeprefix(TURN).removesuffix(END).partition(BODY)
    return unescape(role), unescape(text)


def _coder(vocabulary) -> tuple[Callable, Callable]:
    """``(encode_all, decode)`` between texts and packed ids: of the broadcast vocabulary, or code points."""
    if vocabulary is None:
        return (lambda texts: (t.encode("utf-32-le", "surrogatepass") for t in texts)), (lambda ids: ids.decode("utf-32-le", "surrogatepass"))
    v = bpe._vocabulary(vocabulary.value)
    return v.encode_all, v.decode


def _prefixes(vocabulary):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Formats and encodes the turns of sorted conversations, and names each by the hash of all turns so far."""
        encode_all, _ = _coder(vocabulary)
        fixed = functools.lru_cache(maxsize=1000)(lambda part: next(iter(encode_all([part]))))
        current, path, index, position = None, None, 0, 0
        for pdf in pdfs:
            rows = []
            texts = encode_all([escape(t) for t in pdf["text"]])
            for conv, role, text in zip(pdf["conv"], pdf["role"], texts):
                if conv != current:
                    current, path, index, position = conv, hashlib.blake2b(digest_size=16), 0, 0
                head, _, end = parts_of_turn(role, "")
                ids = [fixed(head), text, fixed(end)]
                size, low = sum(map(len, ids)) // 4, len(ids[0]) // 4
                path.update(size.to_bytes(8, "little") + low.to_bytes(8, "little") + b"".join(ids))
                masked = len(text) // 4 if role == ASSISTANT else 0
                rows.append((conv, index, path.digest(), position, size, b"".join(ids), low if masked else 0, low + masked if masked else 0))
                index, position = index + 1, position + size
            yield pd.DataFrame(rows, columns=["conv", "index", "node", "position", "size", "ids", "loss_from", "loss_to"])

    return run


def prefix_forest(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", vocabulary=None) -> tuple[DataFrame, DataFrame]:
    """``(nodes, paths)`` of all conversations.

    ``nodes``: one row per distinct prefix, so each shared turn is there once: ``owner`` (its
    smallest conversation), ``index``, ``node``, ``position`` (of its first token on the path,
    the position id it starts with), ``size`` in tokens, ``ids`` (packed), and ``loss_from`` to
    ``loss_to``, its tokens under the loss mask. ``paths``: one row per conversation and owner
    on its path: ``conv``, ``owner``, and the turns ``first`` to ``last`` with that owner.

    Turns are ordered by turn, then role and text; repeated rows are turns of their own.
    Null roles and texts count as empty, null turns come first, and rows without a
    conversation id belong to no conversation. Texts of any length are whole turns. An empty
    table gives no rows; other columns are not read.
    """
    spark = turns.sparkSession
    rows = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("conv is not null")
    ordered = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv").sortWithinPartitions("conv", "turn", "role", "text")
    steps = stored(ordered.mapInPandas(_prefixes(vocabulary), "conv long, index int, node binary, position long, size long, ids binary, loss_from long, loss_to long"))
    owners = checkpointed(steps.groupBy("node").agg(F.min("conv").alias("owner")))
    owned = skew_join(steps.select("conv", "index", "node"), owners, ["node"])
    paths = checkpointed(owned.groupBy("conv", "owner").agg(F.min("index").alias("first"), F.max("index").alias("last")))
    nodes = steps.withColumnRenamed("conv", "owner").join(owners, ["node", "owner"])
    return nodes, paths


def segments(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """What each conversation owns, one row for each that owns turns.

    ``root`` and ``path_key`` order the segments of a tree depth-first; ``position`` is the
    position id of the segment's first token (they count on from there), ``size`` its tokens;
    ``attends`` lists the intervals ``(owner, from, to, first, last)`` of position ids (and the
    turns they are) of its ancestors, from the root down, that all of it attends to besides
    what precedes it in the segment itself.
    """
    own = nodes.groupBy("owner").agg(F.min("position").alias("position"), F.sum("size").alias("size"), F.min("index").alias("start"))
    edges = nodes.select("owner", F.col("index").alias("first"), F.col("position").alias("from"))
    ends = nodes.select("owner", F.col("index").alias("last"), (F.col("position") + F.col("size")).alias("to"))
    walked = checkpointed(paths.join(own.select(F.col("owner").alias("conv")), "conv", "left_semi"))
    steps = skew_join(checkpointed(skew_join(walked, edges, ["owner", "first"])), ends, ["owner", "last"])
    gathered = steps.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("first", "owner", "from", "to", "last"))).alias("path"))
    # Depth-first: branches that leave a path later come first, and at one place the smaller owner.
    key = F.concat(F.array(F.col("path")[0]["owner"]), F.flatten(F.transform(F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))), lambda s: F.array(-s["first"].cast("long"), s["owner"]))))
    ancestors = F.transform(F.filter("path", lambda s: s["owner"] != F.col("conv")), lambda s: F.struct(*(s[k].alias(k) for k in ("owner", "from", "to", "first", "last"))))
    return gathered.join(own.withColumnRenamed("owner", "conv"), "conv").select(F.col("path")[0]["owner"].alias("root"), key.alias("path_key"), F.col("conv").alias("owner"), "start", "position", "size", ancestors.alias("attends"))


def emit(nodes: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(emitted, leaves)``: the training output, and where each conversation ends in it.

    ``emitted``: the tokens of every distinct turn once, a row for each turn since segments
    have no bound: ``root``, ``path_key``, ``owner``, ``index`` (in which order they lie
    depth-first), ``position``, ``ids``, ``loss_from``, ``loss_to``, and its segment's
    ``attends``. ``leaves(conv, owner, start, last)``: the segment a conversation ends in, its
    first turn and the conversation's last.
    """
    found = checkpointed(segments(nodes, paths))
    emitted = nodes.join(found.select("owner", "root", "path_key", "attends"), "owner").select("root", "path_key", "owner", "index", "position", "ids", "loss_from", "loss_to", "attends")
    ends = paths.groupBy("conv").agg(F.max(F.struct("last", "owner")).alias("e")).select("conv", F.col("e.owner").alias("owner"), F.col("e.last").alias("last"))
    return emitted, skew_join(checkpointed(ends), found.select("owner", "start"), ["owner"])


def _digests(vocabulary):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Reads whole conversations back from their tokens in order of position, one turn at a time."""
        _, decode = _coder(vocabulary)

        def done(conv, turns, loss, counts):
            return conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state, reached = None, 0
        for pdf in pdfs:
            rows = []
            for conv, position, ids, low, high in zip(pdf["conv"], pdf["position"], pdf["ids"], pdf["loss_from"], pdf["loss_to"]):
                if state is None or state[0] != conv:
                    if state:
                        rows.append(done(*state))
                    state, reached = (conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]), 0
                if position != reached:
                    raise ValueError(f"conversation {conv} goes on at position {position}, not {reached}")
                reached += len(ids) // 4
                formatted = decode(ids)
                role, text = parse_turn(formatted)
                masked = unescape(decode(ids[4 * low : 4 * high]))
                state[1].update(f"{role}\n{text}\n".encode())
                state[2].update(masked.encode())
                for i, more in enumerate((1, len(masked), len(formatted))):
                    state[3][i] += more
            yield pd.DataFrame(rows, columns=columns)
        if state:
            yield pd.DataFrame([done(*state)], columns=columns)

    return run


def read_back(emitted: DataFrame, leaves: DataFrame, vocabulary=None) -> DataFrame:
    """Every conversation's digests, from the emitted tokens alone: those its last segment attends to, then the segment's own up to its last turn, in order of position ids."""
    spark = emitted.sparkSession
    heads = emitted.where(F.size("attends") > 0).groupBy("owner").agg(F.first("attends").alias("attends"))
    whole = skew_join(checkpointed(leaves), heads, ["owner"], "left")
    own = F.struct("owner", F.col("start").alias("first"), "last")
    spans = F.concat(F.coalesce(F.transform("attends", lambda a: F.struct(a["owner"].alias("owner"), a["first"].alias("first"), a["last"].alias("last"))), F.array().cast("array<struct<owner:long,first:int,last:int>>")), F.array(own))
    taken = whole.select("conv", F.explode(spans).alias("s")).select("conv", "s.owner", F.explode(F.sequence("s.first", "s.last")).alias("index"))
    rows = skew_join(checkpointed(taken), emitted.select("owner", "index", "position", "ids", "loss_from", "loss_to"), ["owner", "index"]).drop("owner", "index")
    ordered = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv").sortWithinPartitions("conv", "position")
    return ordered.mapInPandas(_digests(vocabulary), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(turns: DataFrame, probe_id: int = -7, probe: str = "</s>[INST] ok [/INST]") -> DataFrame:
    """``turns`` and one more conversation, whose two texts are control strings."""
    own = turns.sparkSession.createDataFrame([(probe_id, 0, "user", probe), (probe_id, 1, ASSISTANT, probe)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(own)
