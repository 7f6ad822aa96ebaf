"""Chat formatting of reply trees, in DataFrame operations.

Messages are nodes with a parent. Pointer doubling joins the table with itself: after round i a node knows its ancestor
2^i levels up and the score sum of those levels, so roots, depths and path scores take log2(depth) joins. Leaves are
ranked within their tree by path score; for the chosen ones the same jump tables, joined once more each, enumerate the
nodes of the path (each distance is a sum of powers of two, so every node is met once). Only ids and numbers take part;
texts are joined at the end, and each path becomes one conversation.

Control strings inside roles and texts are escaped by one more backslash after their first character, which is undone by
taking one away; the template's own marks hold none, so the output splits into its turns again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longform.llm.common import materialize

# Template marks and control strings of common chat templates: fixed values.
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)"
LOSS_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """Roles stay on their line: backslash and line feed are spelled out."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = F.replace(F.replace(unescape(role), F.lit("\\\\"), F.lit("\x00")), F.lit("\\n"), F.lit("\n"))
    return F.replace(plain, F.lit("\x00"), F.lit("\\"))


def linear_nodes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """Reply trees of plain conversations: every turn answers the one before it.

    Ties and null turns are ordered by role and text; null roles and texts are empty.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"))
    return rows.withColumn("seq", seq).select(
        "conv_id", F.concat(key, F.col("seq").cast("string")).alias("node"),
        F.when(F.col("seq") > 1, F.concat(key, (F.col("seq") - 1).cast("string"))).alias("parent"), "role", "text",
        F.lit(0.0).alias("score"))


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """Tables ``(node, up, gain, low)``: the ancestor 2^i levels up, null past the root; scores and least id between.

    Only nodes that have not reached their root take part in a join.
    """
    links = nodes.select("node", "parent", "score")
    known = links.select(F.col("node").alias("_p"))
    cur = materialize(links.join(known, F.col("parent") == F.col("_p"), "left")
                      .select("node", F.col("_p").alias("up"), F.col("score").alias("gain"),
                              F.least("node", F.coalesce("_p", "node")).alias("low")))
    levels, n = [cur], nodes.count()
    while (1 << (len(levels) - 1)) <= n and not levels[-1].where("up IS NOT NULL").isEmpty():
        cur = levels[-1]
        beyond = cur.select(F.col("node").alias("_n"), F.col("up").alias("_u"), F.col("gain").alias("_g"),
                            F.col("low").alias("_l"))
        moved = cur.where("up IS NOT NULL").join(beyond, F.col("up") == F.col("_n")).select(
            "node", F.col("_u").alias("up"), (F.col("gain") + F.col("_g")).alias("gain"), F.least("low", "_l").alias("low"))
        levels.append(materialize(moved.union(cur.where("up IS NULL"))))
    return levels


def _without_cycles(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    levels = _jumps(nodes)
    rootless = levels[-1].where("up IS NOT NULL")
    if rootless.isEmpty():
        return nodes, levels
    cut = rootless.where("node = low").select(F.col("node").alias("_c"))
    nodes = materialize(nodes.join(cut, F.col("node") == F.col("_c"), "left")
                        .withColumn("parent", F.when(F.col("_c").isNull(), F.col("parent"))).drop("_c"))
    return nodes, _jumps(nodes)


def best_paths(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """``(leaf, root, score, rank, node, dist)`` of the ``top`` best paths of each tree (``None``: all).

    ``dist`` counts from the leaf (0) to the root. A parent that is not there makes a root; a cycle is cut at its
    smallest node. Ties go to the smaller leaf id.
    """
    nodes = materialize(nodes.select("node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
                        .dropDuplicates(["node"]))
    nodes, levels = _without_cycles(nodes)
    inner = nodes.select(F.col("parent").alias("_p")).where("_p IS NOT NULL").distinct()
    leaves = nodes.join(inner, F.col("node") == F.col("_p"), "left_anti").select(F.col("node").alias("leaf"))
    at = leaves.withColumn("node", F.col("leaf")).withColumn("dist", F.lit(0))
    for i, jump in enumerate(levels[:-1]):
        step = jump.where("up IS NOT NULL").select(F.col("node").alias("_n"), "up")
        at = materialize(at.union(at.join(step, F.col("node") == F.col("_n"))
                                  .select("leaf", F.col("up").alias("node"), (F.col("dist") + (1 << i)).alias("dist"))))
    total = levels[-1].select(F.col("node").alias("leaf"), F.col("gain").alias("score"))
    root = at.groupBy("leaf").agg(F.max_by("node", "dist").alias("root"))
    ranked = root.join(total, "leaf").withColumn("rank", F.row_number().over(
        Window.partitionBy("root").orderBy(F.desc("score"), "leaf")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return at.join(ranked, "leaf").select("leaf", "root", "score", "rank", "node", "dist")


def format_paths(nodes: DataFrame, paths: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """``(leaf, rank, score, formatted, loss_spans)``: one conversation per path.

    ``loss_spans`` are the (start, end) code points of the texts of ``loss_roles`` in ``formatted``.
    """
    texts = nodes.select(F.col("node").alias("_n"), escape_role(F.coalesce("role", F.lit(""))).alias("r"),
                         escape(F.coalesce("text", F.lit(""))).alias("t"),
                         F.coalesce("role", F.lit("")).isin(*loss_roles).alias("loss"))
    turns = paths.join(texts, F.col("node") == F.col("_n")).groupBy("leaf", "rank", "score").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("k"), "r", "t", "loss"))).alias("turns"))
    piece = F.transform("turns", lambda x: F.concat(F.lit(START), x["r"], F.lit(MIDDLE), x["t"], F.lit(END)))
    ends = F.aggregate("turns", F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(
        F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
        + F.length(x["r"]) + F.length(x["t"]) + len(START) + len(MIDDLE) + len(END))))
    spans = F.filter(F.zip_with("turns", ends, lambda x, e: F.when(x["loss"], F.struct(
        (e - len(END) - F.length(x["t"])).alias("start"), (e - len(END)).alias("end")))), lambda s: s.isNotNull())
    return turns.select("leaf", "rank", "score", F.array_join(piece, "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Turns ``array<struct<role, text>>`` read back from a formatted conversation."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 1 << 30)
    return F.transform(parts, lambda p: F.struct(
        unescape_role(F.substring_index(p, MIDDLE, 1)).alias("role"),
        unescape(F.substr(p, F.locate(MIDDLE, p) + 1, F.length(p) - F.locate(MIDDLE, p) - len(END))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """``(conv_id, formatted, loss_spans)``: plain conversations as reply trees of one path each.

    A row of the output is a whole conversation. Rows with a null conversation id are one conversation. Other columns
    are not read.
    """
    nodes = materialize(linear_nodes(turns, conv_col, turn_col, role_col, text_col))
    done = format_paths(nodes, best_paths(nodes, top=1))
    owner = nodes.select(F.col("node").alias("leaf"), "conv_id")
    return done.join(owner, "leaf").select("conv_id", "formatted", "loss_spans")
