"""Parse-tree explosion: bracketed tree strings → one row per subtree.

The only per-row Python in the shortcut pipeline: each tree string is parsed
once (Arrow batches in, columnar batches out) and its nodes are emitted in
**post-order** with

``node_no, root, tpl, yield, depth, n_leaves, lhs, rhs, node``

* ``tpl``    template: ``(label child…)`` with every leaf written ``*``
* ``yield``  the node's words; for synchronous trees (``scfg``) each leaf is
             split at its last ``/`` into a left and a right side, the sides
             are joined ``l/r``; underscores are removed, runs of whitespace
             collapse to one blank, an empty side becomes ``ϵ``
* ``depth``  maximum bracket nesting of the template (pre-terminal = 1)
* ``lhs``/``rhs`` root production: label and the tuple of child labels /
             leaf tokens, printed as a Python tuple
* ``node``   ``A -> 'w'`` for one child, ``A -> B C`` otherwise

Unparsable strings (unbalanced brackets, text outside the tree) and trees
without leaves give no rows; ``tree_parse_ok`` flags them so callers can count
what was skipped.  Everything after the explosion is relational.
"""

from __future__ import annotations

import re

from collections.abc import Sequence
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

_TOKEN = re.compile(r"\(|\)|[^\s()]+")
_WS = re.compile(r"\s+")
_WS_OTHER = re.compile(r"[^\S ]")  # whitespace other than a blank
EPSILON = "ϵ"

NODE_SCHEMA = ("node_no int, root string, tpl string, yield string, depth int, "
               "n_leaves int, lhs string, rhs string, node string, n_children int")


def parse(s: str):
    """Bracketed string → nested ``(label, children)``; leaves are strings.
    Explicit stack (no recursion), so deep right-branching trees are fine.
    Returns None when the string is not exactly one well-formed tree."""
    if s is None:
        return None
    toks = _TOKEN.findall(s)
    stack: list[list] = [["", []]]
    i = 0
    n = len(toks)
    while i < n:
        t = toks[i]
        if t == "(":
            label = ""
            if i + 1 < n and toks[i + 1] not in ("(", ")"):
                label = toks[i + 1]
                i += 1
            stack.append([label, []])
        elif t == ")":
            if len(stack) == 1:
                return None
            label, children = stack.pop()
            stack[-1][1].append((label, children))
        else:
            if len(stack) == 1:
                return None
            stack[-1][1].append(t)
        i += 1
    if len(stack) != 1 or len(stack[0][1]) != 1 or isinstance(stack[0][1][0], str):
        return None
    return stack[0][1][0]


def _split_side(s: str) -> tuple[str, str]:
    idx = s.rfind("/")
    if idx < 0:  # a bare leaf without a slash is a left-only leaf
        return s, ""
    return s[:idx], s[idx + 1:]


#: Words and brackets; a bracket with a label and one word is one token.
_PIECE = re.compile(r"\(\s*+([^\s()]++)\s++([^\s()]++)\s*+\)|([()])|([^\s()]++)")


def node_columns(s: str, scfg: bool = False, columns: Sequence[str] = ("tpl", "yield"), max_depth: int | None = None,
                 distinct: bool = False) -> list[tuple] | None:
    """The rows of ``nodes(parse(s), scfg)``, reduced to ``columns``, in one pass over the string; no tree is built.
    ``max_depth`` keeps nodes of up to that depth, ``distinct`` the first of equal rows.  None when the string is not
    exactly one well-formed tree."""
    if s is None:
        return None
    wide = any(c in ("lhs", "rhs", "node", "n_children") for c in columns)      # the production of a node is asked for
    out: dict[tuple, None] | list[tuple] = {} if distinct else []
    add = out.setdefault if distinct else out.append
    place = [NODE_COLS.index(c) for c in columns]
    pick = itemgetter(*place) if len(place) > 1 else lambda r: (r[place[0]],)
    plain = list(columns) == ["tpl", "yield"]
    keep = max_depth is None or max_depth >= 1
    leaf_tpl: dict[str, str] = {}
    no = 0
    # open brackets: label, templates, spans, depth, leaves, names of children, printed children
    stack: list[list] = []
    top: list | None = None
    roots = leaves_all = 0
    label_next = False

    def row(tpl, span, depth, leaves, label, rhs, nd, n_ch):
        if scfg:
            w = span.strip()
            if w.endswith("/"):
                span = w + EPSILON
            elif w.startswith("/"):
                span = EPSILON + w
        if "  " in span:
            span = _WS.sub(" ", span)
        if plain:
            return tpl, span
        sp = tpl.find(" ")
        return pick((no, tpl[1:sp] if sp >= 0 else "", tpl, span, depth, leaves, label, rhs, nd, n_ch))
    for label, word, bracket, text in _PIECE.findall(s):
        if word:
            if top is None:
                roots += 1
            tpl = leaf_tpl.get(label)
            if tpl is None:
                tpl = leaf_tpl[label] = "(" + label + " *)"
            if scfg:
                x, y = _split_side(word)
                raw = (x + "/" + y).replace("_", "")
            else:
                raw = word.replace("_", "") if "_" in word else word
            no += 1
            if keep:
                if scfg:
                    add(row(tpl, raw, 1, 1, label, "(" + repr(word) + ",)", label + " -> '" + word + "'", 1))
                elif plain:
                    add((tpl, raw))
                elif wide:
                    add(pick((no, label, tpl, raw, 1, 1, label, "(" + repr(word) + ",)", label + " -> '" + word + "'", 1)))
                else:
                    add(pick((no, label, tpl, raw, 1, 1)))
            if top is None:
                leaves_all = 1
            else:
                top[1].append(tpl)
                top[2].append(raw)
                if top[3] < 1:
                    top[3] = 1
                top[4] += 1
                if wide:
                    top[5].append(label)
                    top[6].append(label)
            label_next = False
        elif text:
            if label_next:
                top[0] = top[1][0] = text
            elif top is None:
                return None
            else:
                top[1].append("*")
                top[2].append(text)
                top[4] += 1
                if wide:
                    top[5].append(repr(text))
                    top[6].append(text)
            label_next = False
        elif bracket == "(":
            if top is not None:
                stack.append(top)
            else:
                roots += 1
            top = ["", [""], [], 0, 0, [], []]
            label_next = True
        else:
            if top is None:
                return None
            label_next = False
            label, parts, spans, depth, leaves, names, printed = top
            n_ch = len(spans)
            tpl = "(" + " ".join(parts) + ")"
            depth += 1
            if scfg:
                sides = [_split_side(x) for x in spans]
                raw = (" ".join([x for x, _ in sides]) + "/" + " ".join([y for _, y in sides])).replace("_", "")
            else:
                raw = " ".join(spans).replace("_", "")
            no += 1
            if max_depth is None or depth <= max_depth:
                rhs = nd = None
                if wide:
                    rhs = "(" + ", ".join(names) + ("," if len(names) == 1 else "") + ")"
                    nd = f"{label} -> '{names[0]}'" if n_ch == 1 else f"{label} -> {printed[0]} {printed[1]}" if n_ch else f"{label} ->"
                add(row(tpl, raw, depth, leaves, label, rhs, nd, n_ch))
            top = stack.pop() if stack else None
            if top is None:
                leaves_all = leaves
            else:
                top[1].append(tpl)
                top[2].append(raw)
                if top[3] < depth:
                    top[3] = depth
                top[4] += leaves
                if wide:
                    top[5].append(label)
                    top[6].append(label)
    if top is not None or roots != 1:
        return None
    return list(out) if leaves_all else []


def nodes(tree, scfg: bool = False):
    """Post-order node records of a parsed tree (see module doc):
    ``(node_no, root, tpl, yield, depth, n_leaves, lhs, rhs, node, n_children)``."""
    out = []
    work = [(tree, False)]  # iterative post-order: (node, children done?)
    done: dict[int, tuple] = {}  # id(node) -> (tpl, raw span, depth, n_leaves)
    while work:
        node, expanded = work.pop()
        label, children = node
        if len(children) == 1 and isinstance(children[0], str):  # pre-terminal fast path
            w = children[0]
            if scfg:
                a, b = _split_side(w)
                raw = (a + "/" + b).replace("_", "")
            else:
                raw = w.replace("_", "")
            tpl = "(" + label + " *)"
            done[id(node)] = (tpl, raw, 1, 1)
            out.append((tpl, raw, 1, 1, label, "(" + repr(w) + ",)", label + " -> '" + w + "'", 1))
            continue
        if not expanded:
            work.append((node, True))
            for ch in reversed(children):
                if not isinstance(ch, str):
                    work.append((ch, False))
            continue
        parts, spans, names = [label], [], []
        depth = leaves = 0
        for ch in children:
            if isinstance(ch, str):
                parts.append("*")
                spans.append(ch)
                leaves += 1
                names.append(repr(ch))
            else:
                tpl_c, span_c, depth_c, leaves_c = done.pop(id(ch))
                parts.append(tpl_c)
                spans.append(span_c)
                if depth_c > depth:
                    depth = depth_c
                leaves += leaves_c
                names.append(ch[0])
        tpl = "(" + " ".join(parts) + ")"
        if scfg:
            sides = [_split_side(x) for x in spans]
            raw = (" ".join(a for a, _ in sides) + "/" + " ".join(b for _, b in sides)).replace("_", "")
        else:
            raw = " ".join(spans).replace("_", "")
        done[id(node)] = (tpl, raw, depth + 1, leaves)
        rhs = "(" + ", ".join(names) + ("," if len(names) == 1 else "") + ")"
        if len(children) == 1:
            nd = f"{label} -> '{names[0]}'"
        elif children:
            nd = f"{label} -> {_name(children[0])} {_name(children[1])}"
        else:
            nd = f"{label} ->"
        out.append((tpl, raw, depth + 1, leaves, label, rhs, nd, len(children)))
    if not out or out[-1][3] == 0:
        return []
    rows = []
    for k, (tpl, span, depth, leaves, label, rhs, nd, n_ch) in enumerate(out, start=1):
        if scfg:
            w = span.strip()
            if w.endswith("/"):
                span = w + EPSILON
            elif w.startswith("/"):
                span = EPSILON + w
        if "  " in span or _WS_OTHER.search(span):
            span = _WS.sub(" ", span)
        sp = tpl.find(" ")
        rows.append((k, tpl[1:sp] if sp >= 0 else "", tpl, span, depth, leaves, label, rhs, nd, n_ch))
    return rows


def _name(ch) -> str:
    return ch if isinstance(ch, str) else ch[0]


NODE_COLS = ["node_no", "root", "tpl", "yield", "depth", "n_leaves", "lhs", "rhs", "node", "n_children"]
NODE_FIELDS = [T.StructField(c, T.IntegerType() if c in ("node_no", "depth", "n_leaves", "n_children")
                             else T.StringType()) for c in NODE_COLS]


@udtf(returnType=NODE_SCHEMA, useArrow=True)
class ExplodeTree:
    """``explode_tree(tree, scfg)`` — one row per subtree, post-order (for SQL
    ``LATERAL`` use; ``tree_nodes`` uses the faster columnar path)."""

    def eval(self, tree: str, scfg: bool):
        yield from node_columns(tree, bool(scfg), NODE_COLS) or ()


def register_functions(spark) -> None:
    """Make ``explode_tree`` known to the SQL of a session."""
    spark.udtf.register("explode_tree", ExplodeTree)


@F.pandas_udf(T.BooleanType())
def tree_parse_ok(trees: pd.Series) -> pd.Series:
    return pd.Series([parse(t) is not None for t in trees])


#: Node rows after which a frame is handed on: memory does not grow with the trees of a batch.
FRAME_ROWS = 4096


def _explode_batches(keep: list[str], scfg: bool, columns: Sequence[str], schema: pa.Schema, distinct: bool,
                     max_depth: int | None):
    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            of: list[int] = []

            def batch():
                cells = [pa.array(v, schema.field(c).type) for c, v in zip(columns, zip(*rows))]
                return pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(of, pa.int64())) for c in keep), *cells],
                                                  names=[*keep, *columns])
            for i, tree in enumerate(b.column("_tree")):
                # with ``distinct`` all rows of a tree are here: no shuffle tells repeats apart
                got = node_columns(tree.as_py(), scfg, columns, max_depth, distinct)
                if not got:
                    continue
                rows += got
                of += [i] * len(got)
                if len(rows) >= FRAME_ROWS:
                    yield batch()
                    rows, of = [], []
            if rows:
                yield batch()
    return run


def _exploded(df: DataFrame, tree_col: str, scfg: bool, keep: list[str] | None, columns: Sequence[str], distinct: bool = False,
              max_depth: int | None = None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    keep = keep if keep is not None else [c for c in df.columns if c != tree_col]
    base = df.select(*keep, F.col(tree_col).alias("_tree"))
    schema = T.StructType([*(base.schema[c] for c in keep), *(f for c in columns for f in NODE_FIELDS if f.name == c)])
    return base.mapInArrow(_explode_batches(keep, bool(scfg), list(columns), to_arrow_schema(schema), distinct, max_depth), schema)


def tree_nodes(df: DataFrame, tree_col: str = "tree", scfg: bool = False, keep: list[str] | None = None,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Explode ``tree_col`` into node rows: ``keep`` columns (default all but
    the tree) + the node columns, or those of them in ``columns``: others are neither made nor sent.

    Arrow batches in and out (``mapInArrow``), of at most about ``FRAME_ROWS`` nodes and one tree; rows stay where their
    tree is, so a table of few splits should be ``spread`` before."""
    return _exploded(df, tree_col, scfg, keep, [c for c in NODE_COLS if columns is None or c in columns])


def tree_features(df: DataFrame, tree_col: str = "tree", scfg: bool = False, keep: list[str] | None = None,
                  max_depth: int | None = None) -> DataFrame:
    """The set of ``(tpl, yield)`` features of each tree, with ``keep``: the incidence table, each feature of a tree once.
    Repeats within a tree go where it is parsed, so no yield text is shuffled for that; ``max_depth`` keeps templates
    up to that depth.  Trees must differ in their kept columns (an id)."""
    return _exploded(df, tree_col, scfg, keep, ("tpl", "yield"), True, max_depth)


def count_unparsed(df: DataFrame, tree_col: str = "tree") -> DataFrame:
    """Number of tree strings that do not parse (one-row DataFrame)."""
    return df.agg(F.sum((~tree_parse_ok(F.col(tree_col))).cast("long")).alias("skipped"),
                  F.count(F.lit(1)).alias("total"))


def template_leaf_count(tpl) -> Column:
    """Number of ``*`` leaves in a template (filters like ``count('*') >= 2``)."""
    c = F.col(tpl) if isinstance(tpl, str) else tpl
    return F.length(c) - F.length(F.replace(c, F.lit("*"), F.lit("")))


def root_label(tpl) -> Column:
    """Text between ``(`` and the first blank (``""`` without a blank)."""
    c = F.col(tpl) if isinstance(tpl, str) else tpl
    return F.regexp_extract(c, r"^\(([^ ]*) ", 1)


# --------------------------------------------------------------- tree builders
def _leaf_token(t: Column) -> Column:
    """Brackets and slashes inside words would break the bracket format: map
    them to ``-LRB-``, ``-RRB-``, ``-SLASH-`` (Penn Treebank style)."""
    return (F.when(t == "(", "-LRB-").when(t == ")", "-RRB-").when(t == "/", "-SLASH-")
            .otherwise(t))


def flat_tree(tokens, root: str = "S", pre: str = "L") -> Column:
    """``(S (L w1) (L w2) … (L wk))`` over all tokens of a text."""
    leaves = F.transform(tokens if isinstance(tokens, Column) else F.col(tokens),
                         lambda t: F.concat(F.lit(f"({pre} "), _leaf_token(t), F.lit(")")))
    return F.concat(F.lit(f"({root} "), F.array_join(leaves, " "), F.lit(")"))


def pair_tree(a_tokens, b_tokens) -> Column:
    """Synchronous tree over a pair: ``(S (A (L w/) …) (B (L /v) …))``."""
    a = F.transform(F.col(a_tokens), lambda t: F.concat(F.lit("(L "), _leaf_token(t), F.lit("/)")))
    b = F.transform(F.col(b_tokens), lambda t: F.concat(F.lit("(L /"), _leaf_token(t), F.lit(")")))
    return F.concat(F.lit("(S (A "), F.array_join(a, " "), F.lit(") (B "), F.array_join(b, " "),
                    F.lit("))"))
