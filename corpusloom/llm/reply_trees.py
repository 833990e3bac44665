"""Chat formatting of reply trees, with DataFrame functions only.

Messages name their parent. Self-joins that double the reach find every message's root, depth and
score sum in log2(depth) rounds, each over those that haven't reached their root; leaves are ranked by
the mean score of their path, and the paths of the chosen ones are listed by joins over the same
doubled links. Each path is one conversation, and so one string in one task.

Template: a turn is ``<s>``, a role mark, the text and ``</s>``. Marks: ``[INST] `` user, ``[/INST] ``
assistant, ``<<SYS>> `` system, ``[ROLE:hex] `` any other. In texts a backslash is doubled, and one is
set after the first character of every control string; taking both back restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize

_OPENER = r"([<\[])(?=/?s>|/?INST\]|</?SYS>>|ROLE:)"
_MARKS = {"user": "[INST] ", "assistant": "[/INST] ", "system": "<<SYS>> "}


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _OPENER, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def mark(role: Column) -> Column:
    other = F.concat(F.lit("[ROLE:"), F.lower(F.hex(F.encode(role, "UTF-8"))), F.lit("] "))
    out = other
    for name, sign in _MARKS.items():
        out = F.when(role == name, F.lit(sign)).otherwise(out)
    return out


def chains(messages: DataFrame, tree: str, order: str, role: str, text: str) -> DataFrame:
    """Turns in order as a tree without branches: each message's parent is the one before it.

    Rows of an equal ``order`` are told apart by role, then text; a null role or text is empty, rows
    without a tree are one tree, without an id; other columns are ignored, an empty table has no tree.
    """
    rows = messages.select(
        F.col(tree).cast("long").alias("tree"),
        F.col(order).alias("_order"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    node = F.row_number().over(W.partitionBy("tree").orderBy("_order", "role", "text")).cast("long")
    return rows.select("tree", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def reply_paths(nodes: DataFrame, top_k: int = 1) -> DataFrame:
    """The ``top_k`` best root-to-leaf paths of each tree: tree, leaf, rank, path_score, node, pos.

    ``nodes`` has tree, node, parent, score; (tree, node) is unique, a null tree is a tree like others. A
    parent that isn't there makes a root; messages on a cycle have no root and are on no path; a null
    score counts 0; equal scores rank by leaf. ``pos`` counts from 0 at the root. No rows give no rows.
    """
    own = F.struct("tree")  # structs of nulls are equal, so a null tree joins
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    narrow = materialize(nodes.select(own.alias("_t"), "node", "parent", score.alias("score")), "tree-nodes")
    most = narrow.count()
    leaves = narrow.select("_t", F.col("node").alias("leaf")).join(narrow.select("_t", F.col("parent").alias("leaf")).where("leaf IS NOT NULL"), ["_t", "leaf"], "left_anti")
    # links[k] reaches 2 ** k messages up; sum and len are those of the messages passed on the way.
    # done holds the messages whose way ends at a root.
    links = [narrow.where("parent IS NOT NULL").select("_t", "node", F.col("parent").alias("anc"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("len"))]
    done = narrow.where("parent IS NULL").select("_t", "node", F.col("score").alias("sum"), F.lit(1).cast("long").alias("len"))
    while (1 << len(links) - 1) <= most and not links[-1].isEmpty():
        here = links[-1]
        up = here.select("_t", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("sum").alias("sum2"), F.col("len").alias("len2"))
        ended = done.select("_t", F.col("node").alias("anc"), F.lit(None).cast("long").alias("anc2"), F.col("sum").alias("sum2"), F.col("len").alias("len2"))
        # one that isn't there leaves the way as it is
        far = here.join(up.unionByName(ended), ["_t", "anc"], "left").select("_t", "node", F.col("anc2").alias("anc"), (F.col("sum") + F.coalesce("sum2", F.lit(0.0))).alias("sum"), (F.col("len") + F.coalesce("len2", F.lit(0))).alias("len"))
        far = materialize(far, "tree-links")
        done = done.unionByName(far.where("anc IS NULL").drop("anc"))
        links.append(far.where("anc IS NOT NULL"))
    ranked = leaves.join(done.withColumnRenamed("node", "leaf"), ["_t", "leaf"]).withColumn("path_score", F.col("sum") / F.col("len"))
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("_t").orderBy(F.desc("path_score"), "leaf"))).where(F.col("rank") <= top_k)
    paths = materialize(ranked.select("_t", "leaf", "rank", "path_score", (F.col("len") - 1).alias("pos"), F.col("leaf").alias("node")), "tree-paths")
    for k in range(len(links) - 1, -1, -1):
        # of a way that ends at a message that isn't there, that one would be before the root
        above = paths.where(F.col("pos") >= (1 << k)).join(links[k].select("_t", "node", "anc"), ["_t", "node"]).select("_t", "leaf", "rank", "path_score", (F.col("pos") - (1 << k)).alias("pos"), F.col("anc").alias("node"))
        before, paths = paths, materialize(paths.union(above), "tree-paths")
        discard(before)
    return paths.select("_t.tree", "leaf", "rank", "path_score", "node", "pos")


def format_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """One conversation a path: tree, leaf, rank, path_score, formatted, and loss, its masked spans.

    ``loss`` holds (start, length) in code points of ``formatted`` for each assistant text, in order.
    """
    text = escape(F.coalesce(F.col("text"), F.lit("")))
    sign = mark(F.coalesce(F.col("role"), F.lit("")))
    own = F.struct("tree").alias("_t")
    turns = paths.select(own, "leaf", "rank", "path_score", "node", "pos").join(nodes.select(own, "node", "role", "text"), ["_t", "node"]).select(
        "_t", "leaf", "rank", "path_score", "pos", F.concat(F.lit("<s>"), sign).alias("head"), text.alias("body"), (F.col("role") == "assistant").alias("learn")
    )
    piece = turns.withColumn("size", (F.length("head") + F.length("body") + 4).cast("long"))
    before = F.sum("size").over(W.partitionBy("_t", "leaf").orderBy("pos")) - F.col("size")
    placed = piece.select(
        "_t", "leaf", "rank", "path_score",
        F.struct(
            "pos",
            F.concat("head", "body", F.lit("</s>")).alias("piece"),
            F.when(F.coalesce(F.col("learn"), F.lit(False)), F.struct((before + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))).alias("loss"),
        ).alias("turn"),
    )
    whole = placed.groupBy("_t", "leaf").agg(F.first("rank").alias("rank"), F.first("path_score").alias("path_score"), F.sort_array(F.collect_list("turn")).alias("turns"))
    return whole.select(
        "_t.tree", "leaf", "rank", "path_score",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["loss"]), lambda s: s.isNotNull()).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""

    def turn(piece: Column) -> Column:
        piece = F.substring(piece, 4, 2147483647)  # after <s>
        sign = F.substring_index(piece, " ", 1)
        role = F.when(sign.startswith("[ROLE:"), F.decode(F.unhex(F.regexp_extract(sign, r"^\[ROLE:([0-9a-f]*)\]", 1)), "UTF-8"))
        for name, own in _MARKS.items():
            role = F.when(sign == own[:-1], F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescape(F.substr(piece, F.length(sign) + 2)).alias("text"))

    pieces = F.split(formatted, "</s>")
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, one span after another."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def conversation_report(formatted: DataFrame) -> DataFrame:
    """Digests of conversations as read back from their formatted text and loss mask."""
    read = formatted.select(F.col("tree").alias("conv_id"), "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.encode("learned", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


REPORT_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '\', ''))) + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?SYS>>|\[ROLE:')) + 7
    + CASE role WHEN 'user' THEN 7 WHEN 'assistant' THEN 8 WHEN 'system' THEN 8 ELSE 8 + 2 * strlen(role) END AS size FROM said)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""
