"""Newick trees: parsed and written by a stack over the text, one tree per row."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "tree_id string, node bigint, parent bigint, length double, label string, attrs map<string,string>"
_TOKEN = re.compile(r"\[[^\]]*\]|'(?:[^']|'')*'|[(),:;]|[^(),:;\[\]\s]+")
_ATTR = re.compile(r"([^=,{}]+)=(\{[^}]*\}|[^,]*)")
#: What a label may be without quotes.
_PLAIN = re.compile(r"[^\s()\[\]{}:;,'=]+")


def parse(text: str) -> list[tuple[int, int | None, float | None, str | None, dict[str, str]]]:
    """(node, parent, length, label, attributes); of bracketed comments those of the form [&key=value,...] are attributes."""
    nodes: list[list] = [[0, None, None, None, {}]]
    at, expect_length = 0, False
    for token in _TOKEN.findall(text):
        if token[0] == "[":
            if token.startswith("[&"):
                nodes[at][4].update({k.strip(): v.strip() for k, v in _ATTR.findall(token[2:-1])})
        elif token == "(":
            nodes.append([len(nodes), at, None, None, {}])
            at = len(nodes) - 1
        elif token == ",":
            nodes.append([len(nodes), nodes[at][1], None, None, {}])
            at = len(nodes) - 1
        elif token == ")":
            at = nodes[at][1]
        elif token == ":":
            expect_length = True
        elif token == ";":
            break
        elif expect_length:
            nodes[at][2], expect_length = float(token), False
        else:
            nodes[at][3] = token[1:-1].replace("''", "'") if token[0] == "'" else token
    return [tuple(n) for n in nodes]


def quoted(label: str | None) -> str:
    """A label as it is written: in quotes where it has spaces or marks."""
    return "" if not label else label if _PLAIN.fullmatch(label) else "'" + label.replace("'", "''") + "'"


def read(texts: DataFrame) -> DataFrame:
    """(tree_id, newick) to nodes with their attributes."""

    def run(batches):
        for pdf in batches:
            rows = [(t, *n) for t, text in zip(pdf["tree_id"], pdf["newick"], strict=True) for n in parse(text)]
            yield pd.DataFrame(rows, columns=["tree_id", "node", "parent", "length", "label", "attrs"]).astype({"parent": "Int64"})

    return texts.select("tree_id", "newick").mapInPandas(run, NODE)


def with_taxa(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """Parsed nodes as a tree: leaves get as taxon the row index of their label."""
    inner = nodes.where("parent is not null").select("tree_id", F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    rows = nodes.join(inner, ["tree_id", "node"], "left").join(taxa.select("label", "row_ix"), "label", "left")
    return rows.select("tree_id", "node", "parent", "length", F.when(F.col("inner").isNull(), F.col("row_ix")).alias("taxon"))


def gene_trees(lines: DataFrame) -> DataFrame:
    """(tree_id, newick) of lines (value) with one tree each, after any columns before a tab; read.text opens gzip files."""
    last = F.element_at(F.split("value", "\t"), -1)
    rows = lines.select(F.trim(last).alias("newick")).where(F.col("newick").startswith("("))
    return rows.select(F.sha2("newick", 256).alias("tree_id"), "newick")


def write(nodes: DataFrame) -> DataFrame:
    """Nodes to (tree_id, newick); children in order of node."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kids: dict = {}
        for r in pdf.sort_values("node").itertuples():
            kids.setdefault(None if pd.isna(r.parent) else int(r.parent), []).append(r)
        done: dict[int, str] = {}
        stack = [(kids[None][0], False)]
        while stack:
            r, ready = stack.pop()
            below = kids.get(int(r.node), [])
            if below and not ready:
                stack += [(r, True), *((c, False) for c in below)]
                continue
            inner = "(" + ",".join(done[int(c.node)] for c in below) + ")" if below else ""
            done[int(r.node)] = inner + quoted(r.label) + ("" if pd.isna(r.length) else f":{r.length:g}")
        return pd.DataFrame({"tree_id": [pdf["tree_id"].iloc[0]], "newick": [done[int(kids[None][0].node)] + ";"]})

    return nodes.groupBy("tree_id").applyInPandas(run, "tree_id string, newick string")


def read_nexus(texts: DataFrame) -> DataFrame:
    """(tree_id, newick) of NEXUS files (value): the statements of its TREE lines."""
    statement = F.explode(F.regexp_extract_all("value", F.lit(r"(?i)\n\s*tree\s+([^=]+=[^;]*;)"), F.lit(1))).alias("s")
    rows = texts.select(statement)
    return rows.select(F.trim(F.split("s", "=", 2)[0]).alias("tree_id"), F.trim(F.regexp_replace(F.split("s", "=", 2)[1], r"^\s*\[[^\]]*\]", "")).alias("newick"))


def read_nexus_matrix(texts: DataFrame) -> DataFrame:
    """(label, seq) of the MATRIX blocks of NEXUS files (value); a label's lines are joined where the block is interleaved."""
    block = F.explode(F.regexp_extract_all("value", F.lit(r"(?is)\bmatrix\b(.*?);"), F.lit(1)))
    lines = texts.select(block.alias("b")).select(F.posexplode(F.split("b", r"\n")).alias("at", "line")).where(F.trim("line") != "")
    parts = lines.select("at", F.regexp_extract("line", r"^\s*('[^']*'|\S+)\s+(.*)$", 1).alias("name"), F.regexp_replace(F.regexp_extract("line", r"^\s*('[^']*'|\S+)\s+(.*)$", 2), r"\s", "").alias("part"))
    joined = parts.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("x"))
    return joined.select(F.regexp_replace("name", "^'|'$", "").alias("label"), F.array_join(F.col("x.part"), "").alias("seq"))
