"""Token counts that follow edits: per-document segment trees over pre-tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import byte_slices

#: The public byte-level BPE that is used unless a path is given.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where a pre-token of PATTERN ends whatever stands around, and the next begins as a text does:
#: before white space, and between letters, digits and signs (an apostrophe may begin what letters go on).
SAFE = r"""(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])|(?<=')(?=\p{N})"""
#: A leaf ends at the first safe place after this many characters.
LEAF_CHARS = 256
#: Children of a node of a new tree; one of more than twice as many splits.
FAN_OUT = 16
#: Pre-tokens whose counts a Python worker remembers.
CACHE_ROWS = 1_000_000


class _Counts(dict):
    """Token counts by pre-token, made when first asked for."""

    def __init__(self, ranks: bytes, pattern: str, safe: str) -> None:
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.coder = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.safe = regex.compile(safe).search

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_ROWS:
            self.clear()
        n = self[piece] = len(self.coder.encode_ordinary(piece))
        return n

    def of(self, text: str) -> int:
        return sum(map(self.__getitem__, self.split(text)))


@lru_cache(maxsize=2)
def _counts(ranks: bytes, pattern: str, safe: str) -> _Counts:
    return _Counts(ranks, pattern, safe)


class Node:
    """A leaf, or a node over ``kids`` of one height: characters and tokens below it."""

    __slots__ = ("chars", "kids", "text", "tokens")

    def __init__(self, chars: int, tokens: int, kids: list[Node] | None = None, text: str = "") -> None:
        self.chars, self.tokens, self.kids, self.text = chars, tokens, kids, text


def leaves(text: str, counts: _Counts, size: int = LEAF_CHARS) -> list[Node]:
    """Leaves of ``text``, cut at the first safe place after ``size`` characters each."""
    out, at = [], 0
    while at < len(text):
        cut = counts.safe(text, at + size)
        end = cut.start() if cut else len(text)
        out.append(Node(end - at, counts.of(text[at:end]), text=text[at:end]))
        at = end
    return out


def _over(kids: list[Node]) -> Node:
    return Node(sum(k.chars for k in kids), sum(k.tokens for k in kids), kids)


def _bundles(kids: list[Node]) -> list[Node]:
    """Nodes over ``kids``: one if they fit, else as many as make them even."""
    if len(kids) <= 2 * FAN_OUT:
        return [_over(kids)] if kids else []
    n = -(-len(kids) // FAN_OUT)
    return [_over(kids[len(kids) * i // n : len(kids) * (i + 1) // n]) for i in range(n)]


def grow(nodes: list[Node]) -> Node:
    """The root over nodes of one height; without nodes, an empty leaf."""
    while len(nodes) > 1:
        nodes = _bundles(nodes)
    return nodes[0] if nodes else Node(0, 0)


def leaf_at(root: Node, i: int) -> tuple[int, int]:
    """Start and end of the leaf that holds character ``i``."""
    at, node = 0, root
    while node.kids:
        for kid in node.kids:
            if i < at + kid.chars:
                break
            at += kid.chars
        node = kid
    return at, at + node.chars


def pieces(node: Node, a: int, b: int, at: int = 0) -> list[str]:
    """Texts of the leaves between the leaf boundaries ``a`` and ``b``."""
    if not node.kids:
        return [node.text]
    out: list[str] = []
    for kid in node.kids:
        if at < b and at + kid.chars > a:
            out += pieces(kid, a, b, at)
        at += kid.chars
    return out


def swap(node: Node, a: int, b: int, fresh: list[Node], at: int = 0) -> list[Node]:
    """Nodes of ``node``'s height in its place, with the leaves between ``a`` and ``b`` (one at
    least) replaced. Only nodes above those are made again; full ones split, empty ones go."""
    if not node.kids:
        return fresh
    kids: list[Node] = []
    for kid in node.kids:
        if at < b and at + kid.chars > a:
            kids += swap(kid, a, b, fresh, at)
            fresh = []
        else:
            kids.append(kid)
        at += kid.chars
    return _bundles(kids)


def edit(root: Node, edits: list[tuple[int, int, str]], counts: _Counts, size: int = LEAF_CHARS) -> tuple[Node, int]:
    """The tree after (start, length, new text) edits, given for the old text and not
    overlapping (at one place: in the order given), and how many characters were encoded
    again: those of leaves that an edit touches, or whose boundary it touches. A boundary
    holds as long as the characters on either side of it stay where they meet."""
    groups: list[list] = []  # start of the first leaf, end of the last, edits
    for s, n, new in sorted(edits, key=lambda x: x[0]):
        s = min(max(s, 0), root.chars)
        e = min(s + max(n, 0), root.chars)
        a = leaf_at(root, s - 1)[0] if s else 0
        b = leaf_at(root, e)[1] if e < root.chars else root.chars
        if groups and a <= groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], b)
            groups[-1][2].append((s, e, new))
        else:
            groups.append([a, b, [(s, e, new)]])
    again = 0
    for a, b, changes in reversed(groups):  # what is left of a group keeps its place
        old = "".join(pieces(root, a, b))
        part, at = [], a
        for s, e, new in changes:
            part += [old[at - a : s - a], new]
            at = e
        region = "".join([*part, old[at - a :]])
        again += len(region)
        fresh = leaves(region, counts, size)
        root = grow(swap(root, a, b, fresh))
        while root.kids and len(root.kids) == 1:
            root = root.kids[0]
    return root, again


def store(root: Node) -> tuple[list[int], list[list[int]], list[list[int]]]:
    """(characters of each leaf, token sums by level, numbers of children by level), leaves first."""
    level, sums, kids = [root], [], []
    while level[0].kids:
        sums.append([x.tokens for x in level])
        kids.append([len(x.kids) for x in level])
        level = [k for x in level for k in x.kids]
    sums.append([x.tokens for x in level])
    return [x.chars for x in level if x.chars], sums[::-1], kids[::-1]


def restore(text: str, lens: list[int], sums: list[list[int]], kids: list[list[int]]) -> Node:
    """The tree that was stored; nothing is encoded."""
    level, at = [], 0
    for n, tokens in zip(lens, sums[0], strict=False):
        level.append(Node(n, tokens, text=text[at : at + n]))
        at += n
    for widths, own in zip(kids, sums[1:], strict=True):
        above, at = [], 0
        for n, tokens in zip(widths, own, strict=True):
            below = level[at : at + n]
            above.append(Node(sum(k.chars for k in below), tokens, below))
            at += n
        level = above
    return level[0] if level else Node(0, 0)


_TREE = {"lens": "array<int>", "tree": "array<array<int>>", "kids": "array<array<int>>", "n_tokens": "long"}
_LEVELS = pa.list_(pa.list_(pa.int32()))
_TYPES = [pa.list_(pa.int32()), _LEVELS, _LEVELS, pa.int64()]


def build_trees(docs: DataFrame, text_col: str = "text", ranks_path: str = RANKS, pattern: str = PATTERN, safe: str = SAFE) -> DataFrame:
    """All columns of ``docs`` and, added or replaced: ``lens`` (characters of each leaf), ``tree``
    (levels of subtree sums, leaves first), ``kids`` (children of each node, by level above
    the leaves) and ``n_tokens`` (the root).

    Leaves end where a pre-token ends whatever stands around (``safe``, which goes with
    ``pattern``), so their counts add up to the text's. ``ranks_path`` is read by the driver
    and goes with the tasks. No shuffle.

    Defined cases: a null or empty text has no leaves and 0 tokens; repeated rows stay; an
    empty table gives an empty table; very long texts are taken whole, and only a pre-token
    longer than a leaf (a script without spaces or signs) makes a longer leaf.
    """
    rest = [c for c in docs.columns if c not in _TREE and c != text_col]
    ranks = Path(ranks_path).read_bytes()
    schema = docs.select(*rest, text_col, *[F.lit(None).cast(t).alias(n) for n, t in _TREE.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(ranks, pattern, safe)
        for b in batches:
            for part in byte_slices(b, len(rest)):
                cols: list[list] = [[] for _ in _TYPES]
                for text in part.column(len(rest)).to_pylist():
                    root = grow(leaves(text or "", counts))
                    for col, v in zip(cols, (*store(root), root.tokens), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)]], [*rest, text_col, *_TREE])

    return docs.select(*rest, text_col).mapInArrow(run, schema)


def apply_edits(trees: DataFrame, edits_col: str = "edits", text_col: str = "text", ranks_path: str = RANKS, pattern: str = PATTERN, safe: str = SAFE) -> DataFrame:
    """The rows of :func:`build_trees` after their edits: text, ``lens``, ``tree``, ``kids`` and
    ``n_tokens`` renewed, ``n_before`` (long) and ``n_encoded`` (characters encoded again)
    added or replaced, ``edits_col`` dropped.

    ``edits_col`` is an array of (start int, length int, text string), in characters of the
    old text, not overlapping. Starts and lengths beyond the text are cut to it; a null
    array or text is empty. Only touched leaves and their boundary context are encoded, and
    only sums on the paths above them are renewed. Repeated rows each get the result, an
    empty table gives an empty table, very long texts are taken whole.
    """
    own = [edits_col, text_col, *_TREE, "n_before", "n_encoded"]
    rest = [c for c in trees.columns if c not in own]
    ranks = Path(ranks_path).read_bytes()
    names = [*rest, text_col, *_TREE, "n_before", "n_encoded"]
    schema = trees.select(*rest, text_col, *_TREE, F.lit(0).cast("long").alias("n_before"), F.lit(0).cast("long").alias("n_encoded")).schema
    types = [pa.string(), *_TYPES, pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(ranks, pattern, safe)
        for b in batches:
            for part in byte_slices(b, len(rest)):
                cols: list[list] = [[] for _ in types]
                for text, lens, tree, kids, n, edits in zip(*[part.column(len(rest) + i).to_pylist() for i in range(6)], strict=True):
                    changes = [(e["start"], e["length"], e["text"] or "") for e in edits or []]
                    root, again = edit(restore(text or "", lens, tree, kids), changes, counts)
                    for col, v in zip(cols, ("".join(pieces(root, 0, root.chars)), *store(root), root.tokens, n, again), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names)

    return trees.select(*rest, text_col, *_TREE, edits_col).mapInArrow(run, schema)
